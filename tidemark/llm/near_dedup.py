"""Near duplicates by one-permutation hashing, banded buckets and star-shaped candidates.

A document's word shingles are hashed once; the smallest value in each of ``BINS`` bins is its
signature, and an empty bin borrows from the bin that its own sequence of probes meets first
(optimal densification). ``BANDS`` bands of four bins are its buckets. Rows of equal
shingle sets are one node, whose size and two 64-bit sums over the set tell sets apart; ids
play no part in it, so rows that share an id are linked by their own texts.

Buckets of the same members are one bucket. Candidates of a bucket are stars: a centre against
the other members. The first round takes one centre from every bucket, confirms the star's edges
on the full sets and joins components. In a bucket with several components left, the members
outside its main component (the one with most members there) are the next centres: each pair
that is still apart has one of them, so the bucket is done. A bucket with too many pairs of
them gives a few drawn from all its members first, joins components again and goes on with more. So a group of near copies costs a
few stars and its stragglers, small buckets take two rounds and large ones few more, and still every pair of a bucket is either
compared or already connected.

An edge of a star is only made where a bound allows a link: a set's parity bitmap flips one
of ``BITS`` bits for each shingle, so two bitmaps differ in no more bits than the sets differ
in shingles. Near copies that are too far apart so never become pairs, and no link is lost.

With four bins a band and 32 bands, a pair at the threshold of 0.8 misses all buckets with a
probability of 5e-8, at 0.85 of 6e-11.

Defined results: a null or empty text, or one without words, has an empty set and is linked
with nothing; a text of fewer words than a shingle has one shingle, the whole; repeated rows
have equal sets and so one component; rows of a null id are alone, with a null component;
rows that share an id but not the text are documents of their own, which may be in different
components (``component_id`` is the smallest id of a row's own one); an empty table gives none;
further columns are ignored by ``near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import HEAVY_ROWS, join_counted, read_table
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

BINS, BAND_BINS = 128, 4
BANDS = BINS // BAND_BINS
BITS = 512
_PARTS = [f"p{i}" for i in range(BITS // 64)]
#: Bytes of text whose sets a worker holds at a time; a longer text is held alone.
SLICE_BYTES = 1_000_000
#: Centres that a large bucket gives in the second round, about, and times as many in each further
#: one. A bucket of no more pairs than the square of it gives all centres that are needed.
CENTRES, MORE_CENTRES = 16, 64
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

# Odd multipliers and shifts of a 64-bit mixing function.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _S30)) * _M1
        x = (x ^ (x >> _S27)) * _M2
        return x ^ (x >> _S31)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    import xxhash

    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(size, len(found))
    out = mix(h[: len(h) - n + 1], n)
    for k in range(1, n):
        out = mix(out ^ h[k : len(h) - n + 1 + k], k)
    return np.unique(out)


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Densified one-permutation signatures, a row per (non-empty) set."""
    n = len(sets)
    sig = np.full((n, BINS), _EMPTY)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shift = np.uint64(64 - int(math.log2(BINS)))
    np.minimum.at(sig, (row, (flat >> shift).astype(np.int64)), flat)
    first = sig.copy()
    rows, bins = np.nonzero(sig == _EMPTY)
    tries = 0
    while len(rows):
        probe = (mix(bins.astype(np.uint64) * np.uint64(1 << 32) + np.uint64(tries), 7) % np.uint64(BINS)).astype(np.int64)
        got = first[rows, probe]
        sig[rows, bins] = got
        left = got == _EMPTY
        rows, bins, tries = rows[left], bins[left], tries + 1
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, BAND_BINS)
    key = mix(np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy(), 11)
    for k in range(BAND_BINS):
        key = mix(key ^ parts[:, :, k], k + 1)
    return key


def parity(s: np.ndarray) -> np.ndarray:
    """Bitmap of a set in which every element flips one bit."""
    flips = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and shingle sets of a few texts at a time, so that a worker holds few bytes whatever the batch."""
    for batch in batches:
        texts = batch[1].cast(pa.binary())
        first, ends = 0, None
        if batch.num_rows:
            ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + batch.num_rows + 1]
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_BYTES, "right")) - 1)
            yield batch[0].slice(first, last - first), [shingle_set(t.as_py(), size) for t in texts.slice(first, last - first)]
            first = last
        del texts, batch, ends
        pa.default_memory_pool().release_unused()


def lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrays of numbers as one Arrow list column, without Python numbers in between."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def figures(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    """Size and two sums of each set, which tell sets apart."""
    sums = {f"h{k}": [mix(s, salt).sum(dtype=np.uint64) for s in sets] for k, salt in ((1, 101), (2, 202))}
    return {"n": pa.array([len(s) for s in sets], pa.int64())} | {k: pa.array(np.array(v, np.uint64).view(np.int64)) for k, v in sums.items()}


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_id, n, h1, h2, bands) of every row; ``bands`` is empty for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in slices(batches, size):
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signature(full)) if full else ())
            bands = [next(keys) if len(s) else s for s in sets]
            columns = {"doc_id": ids.field(0), "text_id": ids.field(1)} | figures(sets) | {"bands": lists(bands)}
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, "doc_id long, text_id long, n long, h1 long, h2 long, bands array<long>")


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, set, bitmap) of every (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sets in slices(batches, size):
            bits = np.array([parity(s) for s in sets], np.int64).reshape(len(sets), len(_PARTS))
            yield pa.record_batch([nodes, lists(sets), *map(pa.array, bits.T)], names=["node", "set", *_PARTS])

    return texts.mapInArrow(run, ", ".join(["node long", "set array<long>", *[f"{p} long" for p in _PARTS]]))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of the written edges (a, b); comp is the smallest node reachable."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        # The label's own label, from the round before.
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("over"))
        new = cut_lineage(lower.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("over", "comp")).alias("comp")))
        changed = not new.where("old <> comp").isEmpty()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def text_id(text: Column) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(text.cast("string"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: ``doc_id``, ``text_id``, ``n_shingles``, ``component_id``, ``kept`` and ``first``.

    ``first`` holds for the rows of one text of a component, the one of the least (id, text id).
    """
    if 0.01 * percent < 0.7:
        raise ValueError("the bands are made for thresholds of 70 percent and more")
    ids = F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_id(F.col("text")).alias("text_id")).alias("ids")
    rows = docs.select(ids, F.col("text").cast("string").alias("text"))
    sketches = cut_lineage(sketch(rows, shingle))
    known = sketches.where("doc_id is not null and n > 0")
    same = ["n", "h1", "h2"]
    owner = F.struct("doc_id", "text_id")
    nodes = known.groupBy(*same).agg(F.min(owner).alias("owner"), F.min_by("bands", owner).alias("bands"), F.count(F.lit(1)).alias("_n"))
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))
    buckets = nodes.select(F.explode("bands").alias("key"), "node", "n")
    # Near copies share most of their buckets: one of each set of members, known by its size and two sums, stands for all.
    marks = {f"m{k}": F.bit_xor(F.xxhash64("node", F.lit(k))) for k in (1, 2)}
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("main"), *[m.alias(c) for c, m in marks.items()])
    shared = cut_lineage(shared.where("_n > 1").groupBy("_n", "main", *marks).agg(F.min("key").alias("key")).select("key", "main", "_n"))
    members = cut_lineage(join_counted(buckets, shared.select("key", "_n", F.col("_n").alias("crowd")), ["key"]))
    # Bitmaps are several times as long as the rest of a bucket's row: they are made with the sets, of those that share a bucket.
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("owner").alias("ids"), "node")
    # A row may be repeated whole.
    owners = rows.join(wanted, "ids").groupBy("ids").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text")
    edges, labels = confirmed(members, shared.select("key", "main", (F.col("_n") - 1).alias("others")), cut_lineage(full_sets(owners, shingle)), percent)
    by_set = nodes.select(*same, "_n", "owner", "node")
    if edges is not None:
        by_set = by_set.join(labels, "node", "left").withColumn("node", F.coalesce("comp", "node")).drop("comp")
    least = by_set.groupBy("node").agg(F.min("owner").alias("first"))
    by_set = cut_lineage(by_set.join(least, "node").select(*same, "_n", "first"))
    found = join_counted(known.select("doc_id", "text_id", *same), by_set, same)
    mine = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.text_id") == F.col("text_id"))
    found = found.select("doc_id", "text_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), (F.col("first.doc_id") == F.col("doc_id")).alias("kept"), mine.alias("first"))
    alone = sketches.where("doc_id is null or n = 0").select("doc_id", "text_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("first"))
    return found.union(alone)


def confirmed(members: DataFrame, open_: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame | None, DataFrame]:
    """(edges, components) of all similar pairs that share a bucket, in rounds of stars.

    ``open_`` names each bucket's first centre and the number of its other members; ``sets``
    has each member's full set and bitmap. A bucket of a large crowd is dealt to
    several tasks; its stars are sent to each of them.
    """
    shares = F.ceil(F.col("crowd") / HEAVY_ROWS)
    to_all = F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("c_share")
    left = members.join(sets.select("node", *_PARTS), "node").withColumn("comp", F.col("node"))
    labels = sets.select("node", F.col("node").alias("comp"))
    edges = None
    most = 1
    while True:
        if most == 1:
            centre, done = F.col("node") == F.col("main"), F.col("others") == 1
        else:
            counts = left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"))
            main = F.max_by("comp", F.struct("rows", "comp")).alias("main")
            open_ = cut_lineage(counts.groupBy("key").agg(main, (F.sum("rows") - F.max("rows")).alias("others")).where("others > 0"))
            done = F.col("others") * F.col("crowd") <= most * most
            drawn = F.pmod(F.xxhash64("node", F.lit(most)), F.ceil(F.col("crowd") / most)) == 0
            centre = F.when(done, F.col("comp") != F.col("main")).otherwise(drawn)
        if open_.isEmpty():
            return edges, labels
        dealt = left.join(open_, "key").withColumn("share", F.pmod(F.xxhash64("node"), shares)).withColumns({"centre": centre, "done": done})
        dealt = cut_lineage(dealt.drop("main"))
        sent = dealt.where("centre").select(F.col("key").alias("c_key"), to_all, *[F.col(c).alias(f"c_{c}") for c in ("node", "n", "comp", *_PARTS)])
        apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"c_{p}"))) for p in _PARTS), F.lit(0))
        may_link = (
            (F.col("key") == F.col("c_key")) & (F.col("share") == F.col("c_share")) & (F.col("comp") != F.col("c_comp"))
            & (~F.col("centre") | (F.col("node") > F.col("c_node")))
            & (100 * F.least("n", "c_n") >= percent * F.greatest("n", "c_n"))
            & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("c_n")))
        )
        ends = {name: (F.least(c, f"c_{c}"), F.greatest(c, f"c_{c}")) for name, c in (("", "node"), ("comp_", "comp"))}
        columns = [x.alias(f"{name}{side}") for name, both in ends.items() for side, x in zip("ab", both, strict=True)]
        pairs = dealt.join(sent, may_link).select(*columns).distinct()
        with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        both = with_b.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        new = cut_lineage(both.where(similar(F.col("set_a"), F.col("set_b"), percent)).select(*pairs.columns))
        # A bucket whose centres were all there are has no pair left.
        left = dealt.where("not done").select(*left.columns)
        if not new.isEmpty():
            edges = new.select("a", "b") if edges is None else edges.union(new.select("a", "b"))
            joined = components(new.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
            joined = joined.select(F.col("node").alias("comp"), F.col("comp").alias("now"))
            labels = labels.join(joined, "comp", "left").select("node", F.coalesce("now", "comp").alias("comp"))
            left = left.join(joined, "comp", "left").withColumn("comp", F.coalesce("now", "comp")).select(*left.columns)
        left = cut_lineage(left)
        most = CENTRES if most == 1 else most * MORE_CENTRES


def similar(a: Column, b: Column, percent: int) -> Column:
    """Exact test on two full sets."""
    common = F.size(F.array_intersect(a, b))
    return 100 * common >= percent * (F.size(a) + F.size(b) - common)


@query("op7_near_dedup")
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("text_id", "first")
