"""Calls to a paid function that survive lost tasks and reruns: a ledger of answers.

Requests are told by the SHA-256 of their prompt. Answers are appended to a ledger
folder (in the cluster's shared folder or any path Spark writes) in groups of
``group_rows`` requests, each group one Spark job whose files are committed together.
Before asking, the ledger is read and only prompts without an answer are asked; so a
rerun after a failure pays again at most for the group that was running, and a task
retried inside a group repeats at most its own share of that group. Equal prompts are
asked once. ``concurrency`` groups run at a time, each over ``concurrency`` tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.operators.completion import complete
from themeloom.operators.storage import written

GROUP_ROWS = 1000
CONCURRENCY = 4
LEDGER = "request string, response string, error string, group_id string"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def answers(spark: SparkSession, ledger: str) -> DataFrame:
    """One answer per request in the ledger: of repeated ones (a group that ran twice),
    the one with an answer first, then the least group id."""
    if not _exists(spark, ledger):
        return spark.createDataFrame([], LEDGER).drop("group_id")
    rows = spark.read.schema(LEDGER).parquet(ledger)
    best = F.min_by(F.struct("response", "error"), F.struct(F.col("response").isNull(), "group_id"))
    return rows.groupBy("request").agg(best.alias("a")).select("request", "a.response", "a.error")


def complete_durably(
    requests: DataFrame,
    respond: Callable[[str], str],
    ledger: str,
    prompt: str = "prompt",
    group_rows: int = GROUP_ROWS,
    concurrency: int = CONCURRENCY,
    retry_errors: bool = False,
) -> DataFrame:
    """``requests`` with ``response`` and ``error`` from the ledger, asking first what it
    lacks. Rows with a NULL prompt get neither. Answers that were errors are kept as
    such unless ``retry_errors``."""
    spark = requests.sparkSession
    keyed = requests.withColumn("_request", F.sha2(F.col(prompt), 256))
    known = answers(spark, ledger)
    if retry_errors:
        known = known.where(F.col("error").isNull())
    todo = keyed.where(F.col(prompt).isNotNull()).select("_request", F.col(prompt).alias("prompt")).dropDuplicates(["_request"])
    todo = todo.join(known.select(F.col("request").alias("_request")), "_request", "left_anti")
    todo = written(todo)
    count = todo.count()
    if count:
        groups = -(-count // group_rows)
        # fixed once: the ledger grows while the groups run
        todo = written(todo.withColumn("_group", F.pmod(F.xxhash64("_request"), F.lit(groups)).cast("int")))

        def ask(group: int) -> None:
            mine = todo.where(F.col("_group") == group).drop("_group").repartition(concurrency)
            done = complete(mine, respond).select(F.col("_request").alias("request"), "response", "error")
            # a folder per group: its job commits alone, beside groups running at once
            done.write.parquet(f"{ledger}/group_id={uuid.uuid4().hex}")

        with ThreadPoolExecutor(concurrency) as pool:
            list(pool.map(inheritable_thread_target(spark)(ask), range(groups)))
    found = answers(spark, ledger).withColumnRenamed("request", "_request")
    out = keyed.join(found, "_request", "left")
    return out.select(*[F.col(f"`{c}`") for c in requests.columns], "response", "error")
