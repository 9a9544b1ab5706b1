"""Incremental scans with Structured Streaming: the same verdicts as a batch scan, a bounded number of files at a time."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.config import ConfigError, ScanConfig
from palisade.operators import report
from palisade.operators.findings import scanned
from palisade.operators.hashdb import Known
from palisade.operators.rules import RULES
from palisade.operators.tables import scan_agents, scan_handlers
from palisade.operators.trees import tree_scanned
from palisade.schema import FINDINGS
from palisade.sources import sitefiles, stores


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share; a temporary one on a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ConfigError("spark.checkpoint.dir is not set")
        base = "file://" + tempfile.mkdtemp(prefix="palisade-stream-")
    return f"{base.rstrip('/')}/scan-{uuid.uuid4().hex[:12]}"


def scan_stream(files: DataFrame, out: str, checkpoint: str, config: ScanConfig = ScanConfig(), **scan_options):
    """Start a streaming scan of a streaming ``files(path, content)``; verdicts are appended under ``out`` by batch.

    A batch writes to a folder of its number and overwrites it, so a repeated batch leaves one copy."""

    def batch(df: DataFrame, number: int) -> None:
        scanned(df.select("path", "content"), config, **scan_options).write.mode("overwrite").json(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_stream_once(spark: SparkSession, files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Write ``files`` out, stream them in batches of some files for each core, and read the verdicts back. A batch costs a plan of its own, so their
    number goes with the input for each core, not with the input."""
    base = shared_folder(spark)
    schema = files.schema
    files.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4 * spark.sparkContext.defaultParallelism).parquet(f"{base}/in")
    scan_stream(stream, f"{base}/out", f"{base}/checkpoint", config).awaitTermination()
    return spark.read.schema("file_path string, score int, severity string, status string").json(f"{base}/out")


RESULT_SCHEMA = f"file_path string, file_hash string, normalized_hash string, findings {FINDINGS}, score int, severity string, status string, tags array<string>, error string, origin string"


class ScanRun:
    """A scan of a tree in steps: start, step, status, cancel, report; one run at a time for a work folder that driver and tasks share.

    A step is one micro-batch of the ``sitefiles`` stream: its offset in the checkpoint says where the scan stands, so a run
    that another process opens again goes on there, and tasks, not the driver, read the files. Results are written by batch.
    A second stream reads them and keeps the counters in its state. Agents and handlers, if given, come at
    the end of a run that was not cancelled; they count as found, not as processed."""

    def __init__(self, spark: SparkSession, config: ScanConfig, work: str, known: Known | None = None, domains: DataFrame | None = None, agents: DataFrame | None = None, handlers: DataFrame | None = None, modules: DataFrame | None = None, rules=RULES):
        config.confined()
        self.spark, self.config, self.work, self.rules = spark, config, work, rules
        self.known, self.domains, self.agents, self.handlers, self.modules = known, domains, agents, handlers, modules
        self.marker = os.path.join(work, "active.json")

    # -- the session's own files: a few lines each

    def folder(self, *names: str) -> str:
        active = stores.read_json(self.marker) or stores.read_json(os.path.join(self.work, "latest.json")) or {}
        if not active.get("scan_id"):
            raise ConfigError("scan_session_not_found")
        return os.path.join(self.work, active["scan_id"], *names)

    def start(self) -> dict:
        """Take the folder for a new run. A marker whose session is missing or over does not count."""
        os.makedirs(self.work, 0o700, exist_ok=True)
        held = stores.read_json(self.marker)
        if held is not None:
            session = stores.read_json(os.path.join(self.work, str(held.get("scan_id")), "session.json"))
            if session is None or session["status"] != "running":
                os.remove(self.marker)
        try:
            fd = os.open(self.marker, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600)
        except FileExistsError:
            raise ConfigError("scan_already_running") from None
        scan_id = time.strftime("%Y%m%d_%H%M%S_", time.gmtime()) + uuid.uuid4().hex[:8]
        with os.fdopen(fd, "w") as f:
            json.dump({"scan_id": scan_id}, f)
        stores.write_json(os.path.join(self.work, "latest.json"), {"scan_id": scan_id})
        os.makedirs(self.folder("results"), 0o700)
        return self._save({"scan_id": scan_id, "status": "running", "offset": None, "processed_total": 0, "found_total": 0, "findings_total": 0, "runtime_errors_total": 0})

    def _save(self, state: dict) -> dict:
        stores.write_json(self.folder("session.json"), state)
        return state

    def status(self) -> dict:
        state = stores.read_json(self.folder("session.json"))
        if state is None:
            raise ConfigError("scan_session_not_found")
        return state

    def _release(self) -> None:
        if os.path.exists(self.marker):
            os.remove(self.marker)

    # -- the streams

    def _batch(self, rows: DataFrame, number: int) -> None:
        rows = rows.persist()  # at most batch_size files; whole and chunked ones are read apart
        res = tree_scanned(rows, self.config, self.rules, self.known, self.domains, self.config.ast).withColumn("origin", F.lit("file"))
        res.write.mode("overwrite").json(self.folder("results", f"batch={number}"))
        rows.unpersist()

    def _advance(self) -> dict | None:
        """One micro-batch of files; the offset it came to, None if nothing was left."""
        query = sitefiles.read_stream(self.spark, self.config).writeStream.foreachBatch(self._batch).option("checkpointLocation", self.folder("files-checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        ends = [end for p in query.recentProgress if (end := json.loads(p.json)["sources"][0]["endOffset"])]
        return ends[-1] if ends else None

    def _counted(self) -> dict:
        """Let the counters take in the results that are new."""
        place = self.folder("counters")
        stream = self.spark.readStream.schema(RESULT_SCHEMA).option("recursiveFileLookup", "true").json(self.folder("results"))

        def save(df: DataFrame, number: int) -> None:
            stores.write_json(place + ".json", df.first().asDict())  # one row

        query = report.summary(stream).writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", self.folder("counters-checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        return stores.read_json(place + ".json", {})

    def step(self) -> dict:
        """Scan the next files; the run is finished when none are left."""
        state = self.status()
        if state["status"] != "running":
            return state
        offset = self._advance()
        state["offset"] = offset or state["offset"]
        if state["offset"] is None or sitefiles.StreamReader.frontier(self.config, state["offset"]).next_node() is None:
            self._append_tables()
            state["status"] = "finished"
        return self._closed(state | self._counted())

    def _append_tables(self) -> None:
        columns = ["file_path", "file_hash", "normalized_hash", "findings", "score", "severity", "status", "tags"]
        none = F.lit(None).cast("string")
        for name, table in (("agents", self.agents), ("handlers", self.handlers)):
            if table is None:
                continue
            if name == "agents":
                res = scan_agents(table, self.modules, self.config)
            else:
                files = sitefiles.read(self.spark, self.config, chunked="false").where("error IS NULL").select("path", "content")
                res = scan_handlers(table, self.modules, files, self.config).withColumn("normalized_hash", none)
            res.select(*columns, none.alias("error"), F.lit("db").alias("origin")).write.mode("overwrite").json(self.folder("results", name))

    def cancel(self) -> dict:
        """Stop where the scan stands. What was found so far is the report."""
        state = self.status()
        if state["status"] == "running":
            state["status"] = "cancelled"
            state |= self._counted()
        return self._closed(state)

    def _closed(self, state: dict) -> dict:
        self._save(state)
        if state["status"] != "running":
            stores.write_json(self.folder("report.json"), {"format": "palisade-report", "format_version": 1, "partial": state["status"] == "cancelled", "summary": {k: v for k, v in state.items() if k != "offset"}, "config": self.config.to_dict()})
            self._release()
        return state

    def run_to_completion(self, limit: int = 1_000_000) -> dict:
        state = self.start()
        for _ in range(limit):
            if state["status"] != "running":
                break
            state = self.step()
        return state

    def resume_to_completion(self, limit: int = 1_000_000) -> dict:
        """Go on with the run that holds the folder, from where its checkpoint stands; a new one if none does."""
        held = stores.read_json(self.marker)
        running = held is not None and (stores.read_json(os.path.join(self.work, str(held.get("scan_id")), "session.json")) or {}).get("status") == "running"
        state = self.status() if running else self.start()
        for _ in range(limit):
            if state["status"] != "running":
                break
            state = self.step()
        return state

    # -- what it found

    def results(self) -> DataFrame:
        """All results so far, of whole batches."""
        return self.spark.read.schema(RESULT_SCHEMA).option("recursiveFileLookup", "true").json(self.folder("results"))

    def report(self) -> dict:
        got = stores.read_json(self.folder("report.json"))
        if got is None:
            raise ConfigError("report_not_found")
        return got
