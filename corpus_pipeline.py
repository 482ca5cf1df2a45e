"""The training-corpus pipeline: five stages over ``documents``, each reread from Parquet.

1. ``quality_rules``: documents that fail the base rule or are outliers go.
2. ``line_dedup``: later copies of repeated line runs are deleted; a document that was nothing
   but copies goes.
3. ``near_dedup``: one document of each group of near duplicates stays (five-word shingles,
   similarity of 0.8 or more).
4. ``decontaminate``: benchmark passages are cut out; documents that are mostly benchmark go.
5. ``packing``: what is left, as pieces of training sequences.

All stages but the last return the columns of their input, with ``n_chars`` brought up to date
where a text was changed. Null ids are kept apart as each operator says. Rows that share an id
but not the text are documents of their own in every stage; of a row that occurs more than once
with the same id and text, the near-duplicate stage keeps one, the least by its other columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, new_folder, read_table, unboxed
from tidemark.llm.decontaminate import decontaminate as cut_benchmark
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.near_dedup import near_duplicates, text_id
from tidemark.llm.outliers import judge
from tidemark.llm.packing import pack

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _recount(changed: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, ``n_chars`` (if there is one) counted anew."""
    count = F.length("text").cast("long").alias("n_chars")
    return changed.select(*[count if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judge(docs).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = dedup_lines(docs).where((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _recount(left, docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = near_duplicates(docs, shingle=5, percent=80).withColumnsRenamed({"doc_id": "_doc", "text_id": "_text"})
    # A row is known by its id and its text, so rows that share an id are told apart.
    same = ["_doc", "_text"]
    keyed = docs.select(boxed(docs), docs["doc_id"].cast("long").alias("_doc"), text_id(docs["text"]).alias("_text"))
    gone = judged.where("not first").select(*same).distinct()
    left = keyed.join(gone.hint("shuffle_hash"), same, "left_anti")
    # Of a row that occurs more than once one stays, the least by its other columns.
    again = judged.where("first and _doc is not null and n_shingles > 0").groupBy(*same).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*same)
    one = left.join(again, same, "left_semi").groupBy(*same).agg(F.min("_row").alias("_row"))
    return left.join(again, same, "left_anti").select("_row").union(one.select("_row")).select(*unboxed(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(cut_benchmark(docs, read_table(spark, sf_dir, "benchmark")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL cannot express the robust estimates of the first stage or the packing of the last.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
