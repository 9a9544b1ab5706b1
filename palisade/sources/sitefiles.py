"""The ``sitefiles`` data source: trees of files as rows, names with a leading dot included.

Planning lists paths and prunes by extension, exclusions and profile; tasks open the files, leave out binary ones and read the rest.
Each partition is a share of files of about equal bytes. Files over the size limit come in overlapping chunks, with their place
in the file and, on the last one, the SHA-256 of the whole file, taken while it is read. The option ``chunked`` asks for large or
for other files alone; it is answered from the listing, so that the rest is not opened.

The order of a scan is depth first by name, so the last path visited says all of what is left: it is the
stream's offset. A step lists the folders above it and what follows, up to a bound of files and nodes; partitions of
a batch carry paths alone, and tasks read them."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from urllib.parse import quote_from_bytes, unquote_to_bytes

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from palisade.config import ConfigError, ScanConfig, normal_path

SCHEMA = "path string, chunk_index int, length long, mtime timestamp, content string, error string, chunked boolean, start long, start_line int, last boolean, sha256 string"
#: Fixed values of chunked reading.
CHUNK, OVERLAP = 32_768, 512
#: Nodes that a step may visit, for each file wanted and at least.
NODES_PER_FILE, LEAST_NODES = 25, 250
MAGICS = [bytes.fromhex(h) for h in "4D5A 89504E47 FFD8FF 504B0304 25504446 52617221 47494638 7F454C46 494433 0000001866747970".split()]
File = tuple[str, int, float]


def excluded(path: str, prefixes) -> bool:
    p = normal_path(path)
    return any(p == e or p.startswith(e + "/") for e in map(normal_path, prefixes) if e)


def extension(path: str) -> str:
    name = os.path.basename(path)
    return name.rpartition(".")[2].lower() if "." in name else ""


def is_binary_head(head: bytes) -> bool:
    return bool(head) and head.startswith(tuple(MAGICS))


def present_roots(config: ScanConfig) -> list[str]:
    """The roots that exist; a quick scan may miss some, other scans none."""
    roots = config.roots()
    present = [r for r in roots if os.path.exists(r)]
    if not present:
        raise ConfigError("scan_paths_not_found")
    if config.scan_profile != "quick" and len(present) < len(roots):
        raise ConfigError("scan_path_not_found")
    for r in present:
        if not os.path.isfile(r) and not os.path.isdir(r):
            raise ConfigError("scan_path_not_regular_file_or_directory")
    return present


def names_of(folder: str) -> list[str]:
    """Names in order; of names equal but for case the first stays."""
    try:
        names = sorted(os.listdir(folder), key=os.fsencode)
    except OSError:
        return []
    return list({n.lower(): n for n in reversed(names)}.values())[::-1]


class Frontier:
    """The order of a scan, and where it stands. ``at`` is the last path visited and ``root`` the root it lies under."""

    def __init__(self, config: ScanConfig, root: int = 0, at: str = ""):
        self.config, self.root, self.at = config, root, at
        self.roots = present_roots(config)
        self.extensions = set(config.allowed_extensions())
        #: What is left under this root, next on top; built from ``at`` alone.
        self.stack = [self.roots[root]] if not at and root < len(self.roots) else []
        if at:
            base = self.roots[root].rstrip("/")
            folder, parts = base, at[len(base) :].strip("/").split("/") if at != self.roots[root] else []
            for part in parts:
                self.stack += [f"{folder}/{n}" for n in reversed(names_of(folder)) if os.fsencode(n) > os.fsencode(part)]
                folder = f"{folder}/{part}"
            self._descend(at)

    def _covered(self, k: int) -> bool:
        """Root k lies in an earlier one that reaches it: not behind a link."""
        path = self.roots[k]
        for earlier in self.roots[:k]:
            e = normal_path(earlier)
            if normal_path(path) == e:
                return True
            if normal_path(path).startswith(e + "/"):
                between = path[: len(earlier.rstrip("/"))]
                parts = path[len(between) :].strip("/").split("/")
                if not any(os.path.islink(between + "/" + "/".join(parts[: i + 1])) for i in range(len(parts))):
                    return True
        return False

    def _descend(self, path: str) -> None:
        roots = [normal_path(r) for r in self.roots[: self.root]]
        if not os.path.isdir(path) or excluded(path, self.config.exclude_paths) or (normal_path(path) in roots and path != self.roots[self.root]):
            return
        if os.path.islink(path) and path != self.roots[self.root]:
            return
        self.stack += [os.path.join(path, n) for n in reversed(names_of(path))]

    def next_node(self) -> str | None:
        """Visit one node; None when none are left."""
        while not self.stack and self.root + 1 < len(self.roots):
            self.root += 1
            if not self._covered(self.root):
                self.stack = [self.roots[self.root]]
        if not self.stack:
            return None
        self.at = self.stack.pop()
        self._descend(self.at)
        return self.at

    def file_at(self) -> File | None:
        """The node just visited, if it is a file to be scanned."""
        path = self.at
        if extension(path) not in self.extensions or excluded(path, self.config.exclude_paths) or normal_path(path) in map(normal_path, self.roots[: self.root]):
            return None
        if not os.path.isfile(path) or not os.access(path, os.R_OK):
            return None
        st = os.stat(path)
        return path, st.st_size, st.st_mtime

    def files(self) -> Iterator[File]:
        while self.next_node() is not None:
            if found := self.file_at():
                yield found


def walk(config: ScanConfig) -> Iterator[File]:
    """(path, size, mtime) of allowed files of all roots, depth first in name order, each path once. Binary ones are left out by who reads them."""
    return Frontier(config).files()


def read_rows(path: str, size: int, mtime: float, max_bytes: int) -> Iterator[tuple]:
    """Rows of one file in the schema's order: whole, or chunks that keep the last bytes of the one before; none if it is binary.
    Bytes become Latin-1 characters."""
    from datetime import datetime, timezone

    when = datetime.fromtimestamp(mtime, timezone.utc).replace(tzinfo=None)
    chunked, digest = size > max_bytes, hashlib.sha256()
    begun = False
    try:
        with open(path, "rb") as f:
            if is_binary_head(f.read(8)):
                return
            f.seek(0)
            begun = True
            if not chunked:
                data = f.read()
                yield path, 0, size, when, data.decode("latin-1"), None, False, 0, 0, True, hashlib.sha256(data).hexdigest()
                return
            kept, i, at, line = b"", 0, 0, 0
            block = f.read(CHUNK)
            while block:
                after = f.read(CHUNK)
                digest.update(block)
                data = kept + block
                yield path, i, size, when, data.decode("latin-1"), None, True, at, line, not after, None if after else digest.hexdigest()
                gone = max(0, len(data) - OVERLAP)
                kept, i, at, line = data[gone:], i + 1, at + gone, line + data[:gone].count(b"\n")
                block = after
    except OSError:
        what = ("large_file_chunk_read_failed" if begun else "large_file_open_failed") if chunked else "file_read_failed"
        yield path, 0, size, when, None, what, chunked, 0, 0, True, None


class Share(InputPartition):
    def __init__(self, files: list[File]):
        super().__init__(0)
        self.files = files


def config_of(options) -> ScanConfig:
    return ScanConfig.of(**json.loads(options.get("config", "{}")))


def shares(files: Iterator[File], share_bytes: int) -> list[Share]:
    out, held, size = [], [], 0
    for f in files:
        held.append(f)
        size += f[1] + 4096
        if size >= share_bytes:
            out.append(Share(held))
            held, size = [], 0
    return out + [Share(held)] if held else out


class Reader(DataSourceReader):
    def __init__(self, options):
        self.config = config_of(options)
        self.share_bytes = int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))
        asked = options.get("chunked", "")
        self.chunked = None if not asked else asked.lower() == "true"

    def partitions(self):
        limit = self.config.max_file_mb << 20
        return shares((f for f in walk(self.config) if self.chunked is None or (f[1] > limit) == self.chunked), self.share_bytes) or [Share([])]

    def read(self, partition):
        for path, size, mtime in partition.files:
            yield from read_rows(path, size, mtime, self.config.max_file_mb << 20)


class StreamReader(DataSourceStreamReader):
    """Micro-batches of at most ``batch_size`` files and a bounded number of visited nodes. Spark tells a restarted
    reader its last offset by asking for an empty range."""

    def __init__(self, options):
        self.config = config_of(options)
        self.share_bytes = int(options.get("partitionbytes", options.get("partitionBytes", 1 << 20)))
        self.seen: dict | None = None

    def initialOffset(self):
        return {"root": 0, "at": "", "files": 0, "nodes": 0}

    @staticmethod
    def frontier(config: ScanConfig, offset: dict) -> Frontier:
        return Frontier(config, offset["root"], os.fsdecode(unquote_to_bytes(offset["at"])))

    def latestOffset(self):
        start = self.seen or self.initialOffset()
        front, files, nodes = self.frontier(self.config, start), 0, 0
        most = max(self.config.batch_size * NODES_PER_FILE, LEAST_NODES)
        while files < self.config.batch_size and nodes < most and front.next_node() is not None:
            files += front.file_at() is not None
            nodes += 1
        if nodes:
            self.seen = {"root": front.root, "at": quote_from_bytes(os.fsencode(front.at)), "files": start["files"] + files, "nodes": start["nodes"] + nodes}
        return self.seen or start

    def partitions(self, start, end):
        self.seen = self.seen or end
        if start == end:
            return []
        return shares(self._between(start, end), self.share_bytes)

    def _between(self, start: dict, end: dict) -> Iterator[File]:
        front, last = self.frontier(self.config, start), (end["root"], os.fsdecode(unquote_to_bytes(end["at"])))
        for _ in range(end["nodes"] - start["nodes"]):
            if front.next_node() is None:
                return
            if found := front.file_at():
                yield found
            if (front.root, front.at) == last:
                return

    def read(self, partition):
        for path, size, mtime in partition.files:
            yield from read_rows(path, size, mtime, self.config.max_file_mb << 20)


class SiteFiles(DataSource):
    @classmethod
    def name(cls):
        return "sitefiles"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(SiteFiles)


def prepared(spark, reader, config: ScanConfig, options: dict):
    register(spark)
    config.confined()
    present_roots(config)
    return reader.format("sitefiles").option("config", json.dumps(config.to_dict())).options(**options).load()


def read(spark, config: ScanConfig, **options):
    return prepared(spark, spark.read, config, options)


def read_stream(spark, config: ScanConfig, **options):
    return prepared(spark, spark.readStream, config, options)
