"""WARC archives: a writer of one gzip member a record, and a splittable reader.

Writing. Records of equal payloads, of at least ``least`` bytes, are one response (largest id) and
revisits of it. Tasks write whole files under a name of their attempt and rename them, so that a lost
executor or a second attempt leaves one file of each partition; the folder is one that all executors share.

Reading. A task gets a byte range of a file. It looks for the gzip magic from the range's start, takes a
candidate only if its first bytes inflate to a WARC header, and owns the records that start inside its
range; a record may end beyond it. After a valid member the next one starts where it ended; where that
fails, the search goes on from there. Ranges need no index, and any cut of a file gives the same records.

Payloads are hashed where they are read; only digests, lengths and ids are grouped, and the responses that
have revisits are joined back to the rows, broadcast within the bounds of :func:`palisade.llm.common.with_small`.

Defined cases: null payloads are empty. Rows that repeat the id and the payload of a response are responses
too, so every revisit refers to an id that has one. A null id is below all others: such a page revisits, unless
all of equal payload have none. Empty tables give no files and no records. Extra columns are ignored. Bytes between members that are no record are skipped.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import arrow_map, staged, with_small

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a member that must inflate to the start of a header.
PROBE = 512
BLOCK = 1 << 20
DEFAULT_SPLIT = 8 << 20
#: Columns of a record that is read.
RECORDS = {"page_id": "long", "url": "string", "record_type": "string", "refers_to": "long", "payload_bytes": "long", "payload_digest": "string", "payload": "binary"}
KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def marked(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    large = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
    best = staged(large.agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 AND keeper IS NOT NULL").drop("n"), "responses")
    rows = with_small(rows, best, ["payload_digest", "payload_bytes"], "left")
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("keeper")).alias("refers_to"))


def record_bytes(page_id, url, payload: bytes, payload_bytes: int, digest: str, kind: str, refers_to) -> bytes:
    """One record, not compressed. A revisit has the whole payload's digest and length, and no payload."""
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + re.sub(r"[\r\n]", "", url or ""), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {payload_bytes}", "Content-Type: text/html",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of :func:`marked`; a row for each file: path, bytes, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        disk, root = _open(folder)
        disk.create_dir(root, recursive=True)
        name = posixpath.join(root, f"part-{ctx.partitionId():06d}.warc.gz")
        draft, n, size, out = f"{name}.{ctx.taskAttemptId()}.tmp", 0, 0, None
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")]
            for i in range(batch.num_rows):
                out = out or disk.open_output_stream(draft, compression=None)
                data = member(record_bytes(*(c[i].as_py() for c in cols)))
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            disk.move(draft, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    return arrow_map(rows, run, "path string, bytes long, records long")


def fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.lower(): v for k, _, v in pairs}


def parse_record(data: bytes) -> dict | None:
    """The record of an inflated member, or None."""
    head, sep, body = data.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/1."):
        return None
    f = fields(head)
    number = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", s)) else None
    payload = body[: int(f.get("content-length", 0))]
    kind = f.get("warc-type")
    whole = kind == "response"
    return {
        "page_id": number(f.get("warc-record-id", "")), "url": f.get("warc-target-uri"), "record_type": kind, "refers_to": number(f.get("warc-refers-to", "")),
        "payload_bytes": len(payload) if whole else int(f.get("x-payload-length", 0)), "payload_digest": hashlib.sha1(payload).hexdigest() if whole else f.get("warc-payload-digest", "").removeprefix("sha1:"), "payload": payload,
    }


class Window:
    """Bytes of a file from an offset on, read in blocks as they are asked for."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        end = min(self.size, offset + n)
        if offset < self.start or end > self.start + len(self.data):
            self.start = offset
            self.data = self.file.read_at(min(max(n, BLOCK), self.size - offset), offset) if offset < self.size else b""
        return self.data[offset - self.start : end - self.start]


def member_at(window: Window, offset: int) -> tuple[bytes, int] | None:
    """The inflated member at ``offset`` and its end, or None if none with a WARC header starts there."""
    try:
        if not zlib.decompressobj(31).decompress(window.at(offset, PROBE), 7).startswith(b"WARC/1."):
            return None
        z, out, at = zlib.decompressobj(31), [], offset
        while not z.eof:
            block = window.at(at, BLOCK)
            if not block:
                return None
            out.append(z.decompress(block))
            at += len(block)
        return b"".join(out), at - len(z.unused_data)
    except zlib.error:
        return None


def records_in(file, size: int, start: int, end: int) -> Iterator[dict]:
    """Records whose member starts in [start, end)."""
    window, at = Window(file, size), start
    while at < min(end, size):
        if window.at(at, 3) != MAGIC:
            block = window.at(at, BLOCK)
            hit = block.find(MAGIC)
            at += hit if hit >= 0 else max(1, len(block) - 2)
            continue
        found = member_at(window, at)
        record = parse_record(found[0]) if found else None
        if record is None:
            at += 1
            continue
        yield record
        at = found[1]


def read_archives(spark: SparkSession, folder: str, split: int = DEFAULT_SPLIT, columns: tuple[str, ...] = tuple(RECORDS)) -> DataFrame:
    """Every record of the folder's ``.warc.gz`` files, by byte ranges of ``split`` bytes; only ``columns`` leave a worker."""
    disk, root = _open(folder)
    found = disk.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
    files = [(f.path, f.size) for f in found if f.is_file and f.path.endswith(".warc.gz")]
    ranges = spark.createDataFrame(files, "path string, size long").select("path", "size", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {split}L)")).alias("start"))
    n = max(1, sum(-(-s // split) for _, s in files))
    kinds = [KINDS[RECORDS[k]] for k in columns]
    bulky = "payload" in columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = _open(folder)
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], list(columns))
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with own.open_input_file(path) as file:
                    rows, held = [], 0
                    for r in records_in(file, size, start, start + split):
                        rows.append([r[k] for k in columns])
                        held += bulky and len(r["payload"])
                        if held > BLOCK * 4 or len(rows) >= 1000:
                            yield pack(rows)
                            rows, held = [], 0
                    if rows:
                        yield pack(rows)

    return arrow_map(ranges.repartition(min(n, 1 << 16)), run, ", ".join(f"{k} {RECORDS[k]}" for k in columns))
