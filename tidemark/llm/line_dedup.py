"""Repeated runs of lines, found by a suffix array over line numbers and deleted but once.

Every document is a sequence of line numbers (blank lines are left out), and all sequences
together one text with ends that match nothing. The ranks of its suffixes by their first
1, 2, 4, .. lines come from distributed prefix doubling: the rank by ``2h`` lines is the order
of the pairs (rank of the suffix, rank of the suffix ``h`` lines on), numbered after a range
sort. Suffixes whose first ``h`` lines occur nowhere else have their final place and are left
out of further rounds, so a round only holds lines inside repeats.

Suffixes that share their first ``l`` lines stand next to each other in the suffix array: an
interval of a longest common prefix of ``l`` lines or more. With ``h`` the largest power of two
up to ``l`` it is the set of equal pairs (rank by ``h`` lines here, rank by ``h`` lines at
``l - h``). For every place the shortest run of ``min_words`` words that starts there, and the
shortest that ends there, are looked up in this way. Together these runs cover exactly the
lines of all repeated runs of at least ``min_words`` words, so maximal runs come out whole.
The first of an interval in the order (doc_id, digest of the text, place) stays; the lines of
every later one are deleted. A run that overlaps its own first occurrence loses only the lines
beyond it.

Rounds end at the longest run looked up, at most ``min_words`` lines as each line has a word.
Only DataFrame functions are used.

Defined results: a null or empty text has no lines and stays; rows with the same id and text
are one document and get the same text, a null id comes first; blank lines inside a deleted
run go with it; a document may lose all its lines and then has an empty text; an empty table
gives none; further columns are kept, ``n_lines`` and the like are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, boxed, join_counted, read_table
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

#: Words of the shortest run that is a repeat.
MIN_WORDS = 50

#: A document: its id (the least long for a null one), whether it has one, the digest of its text.
_DOC = ["doc", "has_id", "text_id"]


def _key(text: Column) -> list[Column]:
    doc = F.col("doc_id").cast("long")
    return [F.coalesce(doc, F.lit(-(1 << 63))).alias("doc"), doc.isNotNull().alias("has_id"), F.unhex(F.md5(text)).alias("text_id")]


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, has_id, text_id, i, pos, line, w): lines with words, ``i`` counts them, ``pos`` all lines."""
    text = F.col("text").cast("string")
    listed = F.transform(
        F.split(text, "\n"),
        lambda line, pos: F.struct(pos.alias("pos"), F.unhex(F.md5(line)).alias("line"), F.size(F.filter(F.split(line, SPACES), lambda w: w != "")).alias("w")),
    )
    rows = docs.select(*_key(text), listed.alias("listed"))
    rows = rows.select(*_DOC, F.posexplode(F.filter("listed", lambda x: x["w"] > 0)).alias("i", "x"))
    return rows.select(*_DOC, F.col("i").cast("long").alias("i"), F.col("x.pos").cast("long").alias("pos"), F.col("x.line").alias("line"), F.col("x.w").cast("long").alias("w"))


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the classes with several members, with the class's rank as ``rank``.

    The numbers grow with the keys: they are partition and place after a range sort.
    """
    classes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    ranks = cut_lineage(classes.sort(*keys).select(*keys, "_n", F.monotonically_increasing_id().alias("rank")))
    # Rows of a very common line, or pair, stay where they are.
    return join_counted(rows, ranks, keys)


def _segments(lines: DataFrame, min_words: int) -> DataFrame:
    """Runs of neighbouring repeated lines (``line`` is their rank) with enough words."""
    order = Window.partitionBy(*_DOC).orderBy("i")
    gap = F.when(F.lag("i").over(order) == F.col("i") - 1, 0).otherwise(1)
    numbered = lines.withColumn("gap", gap).withColumn("segment", F.sum("gap").over(order)).drop("gap")
    words = F.sum("w").over(Window.partitionBy(*_DOC, "segment"))
    return numbered.withColumn("words", words).where(F.col("words") >= min_words).drop("words")


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc, has_id, text_id, start, length): the shortest runs of ``min_words`` words from and to each line."""
    segment = [*_DOC, "segment"]
    after = F.sum("w").over(Window.partitionBy(*segment).orderBy("i"))
    placed = lines.select(*segment, "i", after.alias("after"), (after - F.col("w")).alias("before"))

    def nearest(row_key, probe_key, descending: bool) -> DataFrame:
        # In this order a probe comes right after the last row that satisfies it.
        rows = placed.select(*segment, row_key.alias("key"), F.lit(0).alias("probe"), F.col("i").alias("at"), F.lit(None).cast("long").alias("i"))
        probes = placed.select(*segment, probe_key.alias("key"), F.lit(1).alias("probe"), F.lit(None).cast("long").alias("at"), "i")
        key = F.col("key").desc() if descending else F.col("key")
        place = F.col("at").desc() if descending else F.col("at")
        w = Window.partitionBy(*segment).orderBy(key, "probe", place)
        both = rows.unionByName(probes).withColumn("near", F.last("at", ignorenulls=True).over(w))
        return both.where("probe = 1 and near is not null").select(*_DOC, "i", "near")

    ahead = nearest(F.col("after"), F.col("before") + min_words, True).select(*_DOC, F.col("i").alias("start"), (F.col("near") - F.col("i") + 1).alias("length"))
    behind = nearest(F.col("before"), F.col("after") - min_words, False).select(*_DOC, F.col("near").alias("start"), (F.col("i") - F.col("near") + 1).alias("length"))
    return ahead.union(behind).distinct()


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, has_id, text_id, from_pos, to_pos): line ranges to delete, not overlapping."""
    lines = cut_lineage(lines_of(docs))
    known = _named(lines, ["line"]).select(*_DOC, "i", "pos", "w", "rank")
    # Rows that are the same document are one.
    known = cut_lineage(_segments(known.dropDuplicates([*_DOC, "i"]), min_words))
    windows = cut_lineage(_windows(known, min_words))
    longest = windows.agg(F.max("length")).first()[0] or 0
    level = known.select(*_DOC, "i", "rank")
    levels, h = [level.withColumn("h", F.lit(1).cast("long"))], 1
    order = Window.partitionBy(*_DOC).orderBy("i")
    while 2 * h <= longest:
        pair = level.select(*_DOC, "i", F.col("rank").alias("r1"), F.lead("rank", h).over(order).alias("r2"), F.lead("i", h).over(order).alias("j"))
        level = cut_lineage(_named(pair.where(F.col("j") == F.col("i") + h).drop("j"), ["r1", "r2"]).select(*_DOC, "i", "rank"))
        h *= 2
        levels.append(level.withColumn("h", F.lit(h).cast("long")))
    ranks = levels[0]
    for other in levels[1:]:
        ranks = ranks.unionByName(other)
    top = F.expr("cast(shiftleft(1L, cast(floor(log2(length)) as int)) as long)")
    wide = windows.withColumn("h", top)
    head = ranks.select(*_DOC, F.col("i").alias("start"), "h", F.col("rank").alias("r1"))
    tail = ranks.select(*_DOC, F.col("i").alias("at"), "h", F.col("rank").alias("r2"))
    wide = wide.join(head, [*_DOC, "start", "h"]).withColumn("at", F.col("start") + F.col("length") - F.col("h"))
    wide = cut_lineage(wide.join(tail, [*_DOC, "at", "h"]).select(*_DOC, "start", "length", "r1", "r2"))
    # One row per interval of several suffixes, with its first in the documents' order.
    place = F.struct(*_DOC, "start")
    intervals = wide.groupBy("length", "r1", "r2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("_n"))
    intervals = cut_lineage(intervals.where("first <> last").drop("last"))
    later = join_counted(wide, intervals, ["length", "r1", "r2"]).where(place != F.col("first"))
    own = F.struct(*_DOC) == F.struct(*[F.col(f"first.{c}").alias(c) for c in _DOC])
    start = F.when(own, F.greatest(F.col("start"), F.col("first.start") + F.col("length"))).otherwise(F.col("start"))
    later = later.select(*_DOC, start.alias("a"), (F.col("start") + F.col("length") - 1).alias("b")).where("a <= b").distinct()
    # Overlapping and touching runs are one.
    by_start = Window.partitionBy(*_DOC).orderBy("a", "b")
    reach = F.max("b").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(F.col("a") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(by_start))
    merged = later.groupBy(*_DOC, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    places = known.select(*[F.col(c).alias(f"k_{c}") for c in _DOC], "i", "pos")

    def at(rows: DataFrame, place: str, name: str) -> DataFrame:
        same = [F.col(c) == F.col(f"k_{c}") for c in _DOC]
        return rows.join(places, [*same, F.col(place) == F.col("i")]).drop(*[f"k_{c}" for c in _DOC], "i").withColumnRenamed("pos", name)

    return at(at(merged, "a", "from_pos"), "b", "to_pos").select(*_DOC, "from_pos", "to_pos")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns, ``text`` without later copies, and ``n_lines``, ``n_deleted``."""
    runs = repeated_runs(docs, min_words).groupBy(*_DOC).agg(F.collect_list(F.struct("from_pos", "to_pos")).alias("_runs"))
    text = F.col("text").cast("string")
    keyed = docs.select(boxed(docs), *_key(text)).withColumnsRenamed({c: f"_{c}" for c in _DOC})
    same = [F.col(f"_{c}") == F.col(c) for c in _DOC]
    # Texts are shuffled once, in the box, at any number of runs, and aren't sorted.
    joined = keyed.join(cut_lineage(runs).hint("shuffle_hash"), same, "left")
    joined = joined.withColumn("_text", F.col("_row.text").cast("string")).withColumn("_lines", F.split("_text", "\n"))
    gone = lambda pos: F.exists("_runs", lambda r: (pos >= r["from_pos"]) & (pos <= r["to_pos"]))
    joined = joined.withColumn("_kept", F.when(F.col("_runs").isNotNull(), F.filter("_lines", lambda line, pos: ~gone(pos))))
    n = F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    deleted = F.when(F.col("_runs").isNull(), 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long")
    new = F.when(F.col("_runs").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    others = [new.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names]
    return joined.select(*others, n.alias("n_lines"), deleted.alias("n_deleted"))


@query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document before, deleted, and the digest of what is left."""
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    left = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_deleted", F.length(left).cast("long").alias("n_chars_left"), F.sha2(left, 256).alias("text_sha256"))
