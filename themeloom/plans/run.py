"""Running single stages or all of them, each from and to written tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.operators.rollups import failure_counts, stage1_summary
from themeloom.operators.storage import written
from themeloom.plans.knowledge import build_store
from themeloom.plans.stage1 import stage1, topic_responses
from themeloom.plans.stage2 import stage2
from themeloom.settings import Settings
from themeloom.sources import articles as A
from themeloom.sources import results
from themeloom.sources.word import read_word_files

STAGES = ("convert", "knowledge", "stage1", "stage2")


@dataclass(frozen=True)
class Analysis:
    """Folders, the caller's functions and the settings of one analysis."""

    documents: str
    results: str
    interviews: str | None = None
    settings: Settings = field(default_factory=Settings)
    respond: Callable[[str], str] | None = None
    vectors_of: Callable[[list[str]], list[list[float]]] | None = None
    style: str = "clean"

    @property
    def articles(self) -> str:
        return f"{self.results}/articles"

    @property
    def store(self) -> str:
        return f"{self.results}/store"


def load_articles(spark: SparkSession, job: Analysis) -> DataFrame:
    """Markdown files if the analysis names a folder of them, else the article table.

    Word files of one stem, such as a.doc and a.docx, are one article.
    """
    if job.interviews is not None:
        return A.read_markdown_files(spark, job.interviews)
    return A.one_per_key(spark.read.parquet(job.articles), "filename")


def convert(spark: SparkSession, job: Analysis) -> DataFrame:
    """Word files to the article table; returns the rows per outcome."""
    read = read_word_files(spark, job.documents, job.style)
    A.write_articles(
        read.withColumn("filename", F.col("output_name")).drop("title", "output_name"),
        job.articles,
    )
    return failure_counts(spark.read.parquet(job.articles))


def knowledge(spark: SparkSession, job: Analysis) -> DataFrame:
    return build_store(
        load_articles(spark, job), "filename", job.store, job.settings, job.vectors_of
    )


def run_stage1(spark: SparkSession, job: Analysis) -> DataFrame:
    loaded = load_articles(spark, job)
    answers = written(topic_responses(loaded, "filename", job.settings, job.respond))
    records = written(stage1(loaded, "filename", job.settings, answers))
    summary = stage1_summary(records)
    results.write_stage1(records, summary, job.results)
    return summary


def run_stage2(spark: SparkSession, job: Analysis) -> DataFrame:
    found = stage2(
        results.read_stage1(spark, job.results), "filename", job.settings, job.respond
    )
    results.write_stage2(found.summary, found.clusters, found.members, found.themes, job.results)
    return found.summary


def _succeeded(stage: str, summary: DataFrame) -> bool:
    if stage == "convert":
        return not summary.where(F.col("error").isNull()).isEmpty()
    if stage == "knowledge":
        return summary.first()["inserted"] > 0
    if stage == "stage1":
        return summary.first()["successful_articles"] > 0
    return True


def run_stage(spark: SparkSession, job: Analysis, stage: str) -> tuple[bool, DataFrame | str]:
    """Outcome of one stage: its summary, or the reason it failed."""
    step = {
        "convert": convert,
        "knowledge": knowledge,
        "stage1": run_stage1,
        "stage2": run_stage2,
    }[stage]
    try:
        summary = step(spark, job)
        return _succeeded(stage, summary), summary
    except Exception as problem:
        return False, str(problem)


def run_all(
    spark: SparkSession, job: Analysis, stages: tuple[str, ...] = STAGES
) -> list[tuple[str, bool, DataFrame | str]]:
    """Run the named stages in order and stop at the first that fails.

    Conversion is left out when the analysis already has markdown files.
    """
    outcome = []
    for stage in stages:
        if stage == "convert" and job.interviews is not None:
            continue
        ok, summary = run_stage(spark, job, stage)
        outcome.append((stage, ok, summary))
        if not ok:
            break
    return outcome
