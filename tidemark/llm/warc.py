"""WARC records in ZIP packages, read back by ranges.

An archive is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz``
(every record a gzip member of its own), ``indexes/index.cdxj`` (a line per record with place
and size) and ``datapackage.json``. The reader never unpacks: it finds the central directory
from the end of the file, with the ZIP64 fields where a size or place does not fit 32 bits,
takes the member's place from its local header, reads the index, and then reads ranges of
neighbouring records.

Pages with equal payloads of at least ``least`` bytes share one record: that of the smallest
page id is a ``response``, the others ``revisit`` it and carry digest and size only. Decisions
are made on digests; payloads are shuffled once, to meet the decision of their page.

A task writes archives of bounded size under names of its own; only archives named by the
manifest, which Spark commits, are read, so a task that ran twice does no harm.

Defined results: a null html is an empty payload; empty and short payloads are responses;
rows with equal ids and payloads are one page's copies, all responses where their id is the
smallest; a null id is never smaller than another, and rows of null ids are responses unless
they revisit; an empty table writes nothing; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import file_system, join_counted, new_folder, read_table
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

#: Smallest payload that another record may stand for.
LEAST_SHARED = 100
#: Bytes after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
#: Bytes of neighbouring records that a reader fetches at once.
RANGE_BYTES = 8 << 20

# The ZIP structures' signatures and the places where 32 bits are full.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    named = "null" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{named}>",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


class ZipWriter:
    """Stored members one after the other; sizes follow each member, so nothing is held."""

    def __init__(self, sink, always64: bool = False) -> None:
        self.sink, self.place, self.members, self.always64 = sink, 0, [], always64

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.place += len(data)

    def begin(self, name: str) -> None:
        self.start, self.name, self.size, self.crc = self.place, name.encode(), 0, 0
        # Bit 3: size and checksum follow the data; version 45 with a ZIP64 field.
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(LOCAL + struct.pack("<5H3I2H", 45, 8, 0, 0, 33, 0, FULL32, FULL32, len(self.name), len(extra)) + self.name + extra)

    def add(self, data: bytes) -> int:
        """Append to the member; the place in it."""
        at = self.size
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._put(data)
        return at

    def end(self) -> None:
        self._put(b"PK\x07\x08" + struct.pack("<IQQ", self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.start))

    def close(self) -> None:
        start = self.place
        for name, crc, size, place in self.members:
            big_size, big_place = self.always64 or size >= FULL32, self.always64 or place >= FULL32
            extra = (struct.pack("<QQ", size, size) if big_size else b"") + (struct.pack("<Q", place) if big_place else b"")
            extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
            shown = FULL32 if big_size else size
            self._put(
                CENTRAL + struct.pack("<6H3I5H2I", 45, 45, 8, 0, 0, 33, crc, shown, shown, len(name), len(extra), 0, 0, 0, 0, FULL32 if big_place else place) + name + extra
            )
        size, count = self.place - start, len(self.members)
        if self.always64 or start >= FULL32 or size >= FULL32 or count >= FULL16:
            at = self.place
            self._put(END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, count, count, size, start))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, at, 1))
            count, size, start = FULL16, FULL32, FULL32
        self._put(END + struct.pack("<4H2IH", 0, 0, count, count, size, start, 0))


def zip_members(read, size: int) -> dict[str, tuple[int, int]]:
    """{name: (place of the data, bytes)} of the stored members; ``read(place, bytes)``."""
    tail_size = min(size, 22 + FULL16)
    tail = read(size - tail_size, tail_size)
    at = tail.rfind(END)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == count or FULL32 in (length, start):
        locator = read(size - tail_size + at - 20, 20)
        if locator[:4] == LOCATOR64:
            (end64,) = struct.unpack_from("<Q", locator, 8)
            record = read(end64, 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of a central directory")
            count, length, start = struct.unpack_from("<3Q", record, 32)
    directory, found, at = read(start, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, whole, n, extra_n, note_n = struct.unpack_from("<IIHHH", directory, at + 20)
        (place,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n].decode()
        extra, e = directory[at + 46 + n : at + 46 + n + extra_n], 0
        while e + 4 <= len(extra):
            kind, length64 = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # holds, in this order, only the fields that are full above
                f = e + 4
                if whole == FULL32:
                    (whole,), f = struct.unpack_from("<Q", extra, f), f + 8
                if packed == FULL32:
                    (packed,), f = struct.unpack_from("<Q", extra, f), f + 8
                if place == FULL32:
                    (place,) = struct.unpack_from("<Q", extra, f)
            e += 4 + length64
        if method == 0:
            n_local, extra_local = struct.unpack("<HH", read(place + 26, 4))
            found[name] = (place + 30 + n_local + extra_local, packed)
        at += 46 + n + extra_n + note_n
    return found


def parse_record(data: bytes) -> dict:
    """Headers and payload facts of one record, the digest taken from the bytes if there are any."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])]
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    kind = fields["WARC-Type"]
    stored = kind == "response"
    digest = hashlib.sha256(payload).hexdigest() if stored else fields["WARC-Payload-Digest"].split(":")[1]
    if stored and fields["WARC-Payload-Digest"] != f"sha256:{digest}":
        raise ValueError(f"record {page}: the payload does not match its digest")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": None if page == "null" else int(page),
        "url": fields.get("WARC-Target-URI"),
        "payload": payload if stored else None,
        "payload_bytes": len(payload) if stored else int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(refers[len("<urn:page:") : -1]) if refers else None,
    }


def decide(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose records revisit another's, without payloads."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    facts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(html).cast("long").alias("size"), F.sha2(html, 256).alias("digest"))
    facts = cut_lineage(facts.where(F.col("size") >= least).select("page_id", "digest").distinct())
    shared = facts.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # Short payloads and those of one page aren't joined; pages of a hot digest stay where they are.
    found = join_counted(facts, cut_lineage(shared), ["digest"])
    return found.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_SHARED, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row; the manifest (archive, bytes)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    said = decide(pages, least).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    same = rows["page_id"].eqNullSafe(said["_page"]) & (rows["digest"] == said["_digest"])
    joined = rows.join(said.hint("shuffle_hash"), same, "left").select("page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        archive = None

        def finish() -> pa.RecordBatch:
            zip_file.end()
            zip_file.begin(INDEX)
            zip_file.add("".join(lines).encode())
            zip_file.end()
            zip_file.begin("datapackage.json")
            zip_file.add(json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())
            zip_file.end()
            zip_file.close()
            sink.close()
            return pa.record_batch([pa.array([archive]), pa.array([zip_file.place], pa.int64())], names=["archive", "bytes"])

        for batch in batches:
            columns = [batch[i].to_pylist() for i in (0, 1, 3, 4)]
            for page_id, url, digest, refers_to, html in zip(*columns, batch[2].cast(pa.binary()).to_pylist(), strict=True):
                if archive is None:
                    archive, lines = f"{uuid.uuid4().hex}.wacz", []
                    sink = system.open_output_stream(f"{root}/{archive}")
                    zip_file = ZipWriter(sink)
                    zip_file.begin(DATA)
                data = gzip_member(record_bytes(page_id, url, html, len(html), digest, refers_to, refers_to is not None))
                place = zip_file.add(data)
                lines.append(f"{'null' if page_id is None else page_id} {json.dumps({'offset': place, 'length': len(data)})}\n")
                if zip_file.place >= archive_bytes:
                    yield finish()
                    archive = None
        if archive is not None:
            yield finish()

    return cut_lineage(joined.mapInArrow(run, "archive string, bytes long"))


def read_index(manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of neighbouring records: (archive, start, places, lengths)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for archive, size in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{archive}") as source:

                    def read(place: int, count: int, source=source) -> bytes:
                        source.seek(place)
                        return source.read(count)

                    members = zip_members(read, size)
                    data_at = members[DATA][0]
                    lines = read(*members[INDEX]).decode().splitlines()
                held: list[tuple[int, int]] = []

                def block(held=None, archive=archive) -> pa.RecordBatch:
                    return pa.record_batch(
                        [pa.array([archive]), pa.array([[h[0] for h in held]], pa.list_(pa.int64())), pa.array([[h[1] for h in held]], pa.list_(pa.int64()))],
                        names=["archive", "places", "lengths"],
                    )

                for line in lines:
                    entry = json.loads(line.split(" ", 1)[1])
                    held.append((data_at + entry["offset"], entry["length"]))
                    if held[-1][0] + held[-1][1] - held[0][0] >= range_bytes:
                        yield block(held)
                        held = []
                if held:
                    yield block(held)

    return manifest.mapInArrow(run, "archive string, places array<long>, lengths array<long>")


def read_records(manifest: DataFrame, folder: str, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of the manifest's archives, read by ranges."""
    tasks = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    ranges = read_index(manifest.repartition(tasks, "archive"), folder, range_bytes)
    ranges = ranges.repartition(tasks, "archive", F.col("places")[0])
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if with_payload:
        fields.append(("payload", pa.binary()))
        schema += ", payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for archive, places, lengths in zip(*(batch[i].to_pylist() for i in range(3)), strict=True):
                with system.open_input_file(f"{root}/{archive}") as source:
                    source.seek(places[0])
                    data = source.read(places[-1] + lengths[-1] - places[0])
                found = [parse_record(zlib.decompress(data[p - places[0] : p - places[0] + n], 31)) for p, n in zip(places, lengths, strict=True)]
                yield pa.record_batch([pa.array([f[name] for f in found], kind) for name, kind in fields], names=[name for name, _ in fields])

    return ranges.mapInArrow(run, schema)


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, q.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM q LEFT JOIN f ON q.payload_digest = f.payload_digest
"""


@query("op1_warc", OP1_SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    manifest = write_archives(read_table(spark, sf_dir, "pages"), folder)
    return read_records(manifest, folder, with_payload=False).drop("url")
