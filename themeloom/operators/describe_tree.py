"""Cluster descriptions over all themes: batches described, then descriptions combined.

Level 0 puts every theme of a cluster in one of ceil(n / BATCH_LINES) batches, by a
hash of article and theme, so a cluster with a third of all themes is many batches and
no window gathers it. Each batch is described by one call. While a cluster has more
than one description, FAN_IN of them at a time (again by hash) are combined by one call
into one. A cluster of n themes thus costs about n / BATCH_LINES * (1 + 1 / FAN_IN +
1 / FAN_IN^2 + ...) calls, and one when it fits one batch. Every level is written
before the next, so no paid call is repeated when a later step fails.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom import fixed
from themeloom.functions.prompts import ANSWER_WITH, CLUSTER_ANSWER_SHAPE, cluster_prompt, theme_line
from themeloom.functions.responses import parsed_answers
from themeloom.operators.completion import complete
from themeloom.operators.storage import written

BATCH_LINES = 20
FAN_IN = 8
COMBINE_REQUEST = (
    "These are descriptions of parts of one cluster of articles. "
    "Combine them into one description of the whole cluster."
)


def combine_prompt(articles_count: Column, parts: Column) -> Column:
    return F.concat(
        articles_count.cast("string"),
        F.lit(" articles. " + COMBINE_REQUEST + "\nParts:\n"),
        F.array_join(parts, "\n"),
        F.lit(ANSWER_WITH + CLUSTER_ANSWER_SHAPE),
    )


def _groups(rows: DataFrame, cluster: str, size: int, salt: list[str]) -> DataFrame:
    """``rows`` with _group: one of ceil(n / size) groups of their cluster, by hash."""
    counts = rows.groupBy(cluster).agg(F.count("*").alias("_n"))
    many = F.greatest(F.lit(1), F.ceil(F.col("_n") / size))
    return rows.join(counts, cluster).withColumn(
        "_group", F.pmod(F.xxhash64(*salt), many).cast("long")
    ).drop("_n")


def describe_clusters(
    themes: DataFrame,
    sizes: DataFrame,
    article: str,
    respond: Callable[[str], str],
    cluster: str = "cluster_number",
) -> tuple[DataFrame, DataFrame]:
    """``(answers, calls)``: one answer per cluster (``cluster, response, error``) from
    all its themes, and the calls made per cluster and level (``cluster, level, calls``).

    ``themes`` has ``cluster, article, theme_no, name, description``; ``sizes`` has
    ``cluster, size`` (articles). A batch whose call fails yields an error; a combination
    of parts of which some failed combines the others and carries the first error.
    """
    line = theme_line(F.col(article).cast("string"), F.col("name"), F.col("description"))
    lines = _groups(themes.select(cluster, article, "theme_no", line.alias("line")), cluster, BATCH_LINES, [article, "theme_no"])
    batches = lines.groupBy(cluster, "_group").agg(
        F.array_sort(F.collect_list(F.struct(F.col(article).alias("a"), "theme_no", "line"))).alias("l")
    )
    asked = batches.join(sizes, cluster).select(
        cluster, "_group", cluster_prompt(F.col("size"), F.col("l.line")).alias("prompt")
    )
    level = written(complete(asked, respond).select(cluster, "_group", "response", "error"))
    calls = [level.groupBy(cluster).agg(F.lit(0).alias("level"), F.count("*").alias("calls"))]
    depth = 0
    while True:
        many = level.groupBy(cluster).agg(F.count("*").alias("_k")).where("_k > 1").select(cluster)
        if many.isEmpty():
            break
        depth += 1
        done = level.join(many, cluster, "left_anti")
        open_ = _groups(level.join(many, cluster), cluster, FAN_IN, [cluster, "_group", "response"])
        parts = open_.groupBy(cluster, "_group").agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("response", F.lit("")).alias("r"), "error"))).alias("p"),
        )
        first_error = F.get(F.filter("p", lambda x: x["error"].isNotNull()), 0)["error"]
        kept = F.filter("p", lambda x: x["error"].isNull())
        asked = parts.join(sizes, cluster).select(
            cluster, "_group",
            F.when(F.size(kept) > 0, combine_prompt(F.col("size"), F.transform(kept, lambda x: x["r"]))).alias("prompt"),
            first_error.alias("_error"),
        )
        answered = complete(asked, respond).select(
            cluster, "_group", "response", F.coalesce("error", "_error").alias("error"),
            F.col("prompt").isNotNull().alias("_called"),
        )
        fresh = written(answered)
        calls.append(fresh.where("_called").groupBy(cluster).agg(F.lit(depth).alias("level"), F.count("*").alias("calls")))
        level = written(done.unionByName(fresh.drop("_called")))
    counted = calls[0]
    for more in calls[1:]:
        counted = counted.unionByName(more)
    return level.select(cluster, "response", "error"), counted


def calls_for(themes: int) -> int:
    """Calls ``describe_clusters`` makes at most for a cluster of ``themes`` themes."""
    n, total = math.ceil(max(themes, 1) / BATCH_LINES), 0
    total += n
    while n > 1:
        n = math.ceil(n / FAN_IN)
        total += n
    return total


def parsed(answers: DataFrame) -> DataFrame:
    return parsed_answers(answers, fixed.CLUSTER_ANSWER)
