"""Planning uploads of files in bounded batches.

Next-fit is sequential: whether a file opens a batch depends on all files before it. But where
the batch after one begins depends on a few files only, and a batch holds at most
``max_items`` of them, so a block of files is entered at one of that many places. The ways
through the blocks are pointers, which are followed by doubling instead of one after the other.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.registry import last_per_key
from tidemark.operators.skew import SEGMENT_ROWS, numbered_in, running
from tidemark.session import cut_lineage

# Batch limits, the outcome of a file without a result.
MAX_ITEMS = 25
MAX_BYTES = 6_000_000
#: Files of one block, which one array expression holds.
BLOCK_FILES = 1024
NO_RESULT = "NO_RESULT"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def scan_directory(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Regular files below a folder; none when it does not exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    missing = not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    if missing:
        schema = "root string, path string, file_name string, size bigint"
        return spark.createDataFrame([], schema + (", content binary" if content else ""))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    extra = ["content"] if content else []
    return files.select(
        F.lit(root).alias("root"), "path", base_name(F.col("path")).alias("file_name"),
        F.col("length").alias("size"), *extra,
    )


def _blocks(files: DataFrame, rows: int, max_items: int) -> DataFrame:
    """(root, block, sizes, n): ``rows`` consecutive files each, with the sizes of the next few after them."""
    block = F.floor(F.col("i") / rows).cast("bigint")
    ahead = (F.col("i") % rows < max_items) & (F.col("i") >= rows)
    # The first files of a block are looked at by the last ones of the block before.
    to = F.explode(F.when(ahead, F.array(block, block - 1)).otherwise(F.array(block))).alias("block")
    listed = files.select("root", "i", "size", to).groupBy("root", "block").agg(F.sort_array(F.collect_list(F.struct("i", "size"))).alias("x"))
    own = F.least(F.size("x"), F.lit(rows))
    return listed.select("root", "block", F.col("x.size").alias("sizes"), own.alias("n"))


def _held(max_items: int, max_bytes: int) -> Column:
    """For a batch opened at each file of a block, the files it holds."""
    none = F.struct(F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("full"))

    def add(s: Column, size: Column) -> Column:
        # The first file is taken whatever its size.
        fits = ~s["full"] & ((s["k"] == 0) | (s["used"] + size <= max_bytes))
        return F.struct((s["k"] + fits.cast("int")).alias("k"), (s["used"] + F.coalesce(size, F.lit(0))).alias("used"), (~fits).alias("full"))

    return F.transform(F.sequence(F.lit(1), F.col("n")), lambda p: F.aggregate(F.slice("sizes", p, max_items), none, add)["k"])


def _walked(entry: Column) -> Column:
    """Where the batches lead that begin at ``entry``: the next start behind the block, and the starts inside."""
    none = F.struct(entry.cast("int").alias("at"), F.lit(0).cast("bigint").alias("starts"), F.lit(0).alias("last"), F.lit(0).alias("p"))

    def over(s: Column, held: Column) -> Column:
        opens = s["at"] == s["p"]
        return F.struct(
            (s["at"] + F.when(opens, held).otherwise(0)).alias("at"), (s["starts"] + opens.cast("int")).alias("starts"),
            F.when(opens, s["p"]).otherwise(s["last"]).alias("last"), (s["p"] + 1).alias("p"),
        )

    return F.aggregate("held", none, over)


def _placed(entry: Column, batch: Column, since: Column) -> Column:
    """(batch_no, position) of each file of a block that is entered at ``entry``."""
    none = F.struct(
        entry.cast("int").alias("at"), (batch - 1).cast("bigint").alias("batch_no"), since.cast("bigint").alias("position"), F.lit(0).alias("p"),
        F.array().cast("array<struct<batch_no:bigint,position:bigint>>").alias("out"),
    )

    def over(s: Column, held: Column) -> Column:
        opens = s["at"] == s["p"]
        number, place = s["batch_no"] + opens.cast("int"), F.when(opens, F.lit(0).cast("bigint")).otherwise(s["position"])
        return F.struct(
            (s["at"] + F.when(opens, held).otherwise(0)).alias("at"), number.alias("batch_no"), (place + 1).alias("position"), (s["p"] + 1).alias("p"),
            F.concat(s["out"], F.array(F.struct(number.alias("batch_no"), place.alias("position")))).alias("out"),
        )

    return F.aggregate("held", none, over)["out"]


def _entries(blocks: DataFrame, max_items: int, most: int) -> DataFrame:
    """(root, block, entry, batch, since): where the first batch of each block begins, and its number.

    ``since`` is the place that the block's first file has in the batch that came into it. The
    way through a block, from each place it may be entered at, is a pointer into the next
    block; pointers over 1, 2, 4, .. blocks are joined, and taken from the root's first file.
    """
    ways = blocks.select("root", "block", "n", "held", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(max_items)) - 1)).alias("entry"))
    ways = ways.withColumn("w", _walked(F.col("entry")))
    step = cut_lineage(ways.select("root", "block", "entry", (F.col("w.at") - F.col("n")).alias("to"), F.col("w.starts").alias("starts"), (F.col("n") - F.col("w.last")).cast("bigint").alias("since")))
    steps, far = [step], 1
    while 2 * far < most:
        one = steps[-1]
        two = one.select("root", (F.col("block") - far).alias("block"), F.col("entry").alias("to"), F.col("to").alias("to2"), F.col("starts").alias("starts2"), F.col("since").alias("since2"))
        joined = one.join(two, ["root", "block", "to"])
        steps.append(cut_lineage(joined.select("root", "block", "entry", F.col("to2").alias("to"), (F.col("starts") + F.col("starts2")).alias("starts"), F.col("since2").alias("since"))))
        far *= 2
    found = blocks.where("block = 0").select("root", "block", F.lit(0).alias("entry"), F.lit(0).cast("bigint").alias("batch"), F.lit(0).cast("bigint").alias("since"))
    if most <= 1:
        return found
    for pointers in reversed(steps):
        on = found.drop("since").join(pointers, ["root", "block", "entry"])
        ahead = on.select("root", (F.col("block") + far).alias("block"), F.col("to").alias("entry"), (F.col("batch") + F.col("starts")).alias("batch"), "since")
        found = cut_lineage(found.unionByName(ahead))
        far //= 2
    return found


def plan_batches(
    files: DataFrame,
    max_items: int = MAX_ITEMS,
    max_bytes: int = MAX_BYTES,
    order: str = "path",
    block_rows: int = BLOCK_FILES,
) -> DataFrame:
    """Next-fit batches per ``root`` in order: adds ``batch_no`` and ``position`` (B1).

    A batch is closed before a file when it holds ``max_items`` files or the file would take
    it over ``max_bytes``; a larger file travels alone. ``order`` is unique within a root.

    Files are numbered in their root and cut into blocks of ``block_rows``. What a batch opened
    at a file would hold needs only the next few files, and how batches run through a block only
    where its first one begins, so a root of any size is spread over all tasks.
    """
    rows = max(block_rows, max_items)
    numbered = cut_lineage(numbered_in(files, ["root"], [order], "i"))
    most = numbered.agg(F.max("i")).first()[0]
    if most is None:
        return files.select("*", F.lit(0).cast("bigint").alias("batch_no"), F.lit(0).cast("bigint").alias("position"))
    blocks = _blocks(numbered, rows, max_items).withColumn("held", _held(max_items, max_bytes)).drop("sizes")
    blocks = cut_lineage(blocks)
    entered = blocks.join(_entries(blocks, max_items, most // rows + 1), ["root", "block"])
    placed = entered.select("root", "block", F.posexplode(_placed(F.col("entry"), F.col("batch"), F.col("since"))).alias("p", "x"))
    placed = placed.select("root", (F.col("block") * rows + F.col("p")).alias("i"), "x.batch_no", "x.position")
    return numbered.join(placed, ["root", "i"]).select(*files.columns, "batch_no", "position")


def batch_table(plan: DataFrame) -> DataFrame:
    """One row per batch: files, bytes, and how it is sent (B2)."""
    per = plan.groupBy("root", "batch_no").agg(
        F.count(F.lit(1)).alias("items"), F.sum("size").cast("bigint").alias("bytes")
    )
    return per.withColumn("strategy", F.when(F.col("items") == 1, "SINGLE").otherwise("BATCH"))


def item_outcomes(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Each planned file with its upload result, by batch and position."""
    place = ["root", "batch_no", "position"]
    r = last_per_key(results.select(*place, "success", "message"), place).withColumn("_got", F.lit(True))
    joined = plan.join(r, ["root", "batch_no", "position"], "left")
    return joined.withColumns(
        {
            "success": F.coalesce("success", F.lit(False)),
            "message": F.when(F.col("_got").isNull(), NO_RESULT).otherwise(F.col("message")),
        }
    ).drop("_got")


def upload_summary(outcomes: DataFrame) -> DataFrame:
    """Totals per root (A10). The item list is the outcome table itself."""
    return outcomes.groupBy("root").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("failure_count"),
    )


def progress(outcomes: DataFrame, limit: int = SEGMENT_ROWS) -> DataFrame:
    """Uploaded files and per cent after each batch, in order."""
    per_batch = outcomes.groupBy("root", "batch_no").agg(
        F.count_if("success").alias("done"), F.count(F.lit(1)).alias("items")
    )
    total = per_batch.groupBy("root").agg(F.sum("items").alias("total_count"))
    run = running(per_batch, ["root"], ["batch_no"], {"processed": ("sum", F.col("done"))}, limit=limit)
    return run.join(total, "root").select(
        "root", "batch_no", "processed", "total_count",
        (F.col("processed") * 100.0 / F.col("total_count")).alias("percent"),
    )


def upload_payloads(files: DataFrame) -> DataFrame:
    """The JSON each file is sent as: title, path, base64 content."""
    return files.select(
        "path",
        F.to_json(
            F.struct(
                F.col("file_name").alias("Title"),
                F.col("path").alias("PathOnClient"),
                # base64() breaks lines after 76 characters
                F.translate(F.base64("content"), "\r\n", "").alias("VersionData"),
            )
        ).alias("payload"),
    )


def write_summary(outcomes: DataFrame, path: str, stamp: str) -> str:
    """The run's totals as one indented file ``upload-<stamp>.json``, the items beside it as JSON lines."""
    spark = outcomes.sparkSession
    outcomes.write.mode("overwrite").json(f"{path}/items-{stamp}")
    [totals] = upload_summary(outcomes.withColumn("root", F.lit(0)).select("root", "success")).drop("root").collect() or [None]
    counts = {"total_count": 0, "success_count": 0, "failure_count": 0} if totals is None else totals.asDict()
    name = f"{path}/upload-{stamp}.json"
    target = spark._jvm.org.apache.hadoop.fs.Path(name)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(counts, indent=2), "utf-8"))
    out.close()
    return name
