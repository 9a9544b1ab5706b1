"""Report queries: summaries, finding rows, tag filter, sorts, pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.hashes import fingerprint
from palisade.operators.findings import has_risk, normal_tags
from palisade.schema import FIELDS

SORTABLE = tuple(k for k in FIELDS if k != "tags") + ("file_path", "status", "tags")
NUMERIC = ("score", "length", "entropy", "line", "offset")


def summary(results: DataFrame) -> DataFrame:
    """One row of counters; error rows count as processed alone, rows of tables (``origin`` db) as found and not as processed."""
    f = F.col("findings")
    error = F.col("status") == "error"
    info = F.exists(f, lambda x: x["score"] <= 0)
    file = F.col("origin") == "file" if "origin" in results.columns else F.lit(True)
    return results.agg(
        F.count_if(file).alias("processed_total"), F.count_if(~error & has_risk(f)).alias("found_total"), F.count_if(~error & info).alias("informational_files"), F.count_if(F.col("status") == "skipped").alias("skipped_total"),
        F.count_if(error).alias("runtime_errors_total"), F.coalesce(F.sum(F.size(f)), F.lit(0)).cast("long").alias("findings_total"),
        F.coalesce(F.sum(F.size(F.filter(f, lambda x: x["score"] <= 0))), F.lit(0)).cast("long").alias("informational_total"),
    )


def report_tags(results: DataFrame) -> DataFrame:
    return results.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def finding_rows(results: DataFrame) -> DataFrame:
    """A row for each finding, with its place in the file's list."""
    return results.select("file_path", "status", F.posexplode("findings").alias("pos", "f")).select("file_path", "status", "pos", "f.*")


#: Columns of the projection that come from a finding's trace: name and the trace's keys, first that is there.
TRACE_COLUMNS = {
    "entity_type": ("entity",), "db_id": ("id",), "db_module_id": ("module_id", "to_module_id"), "db_from_module_id": ("from_module_id",), "db_message_id": ("message_id",), "db_to_class": ("to_class",), "db_to_method": ("to_method",),
    "db_sort": ("sort",), "db_active": ("active",), "db_next_exec": ("next_exec",), "risk_reason": ("risk_reason",), "resolved_file": ("resolved_file",),
}
TEXTS = ("signature_id", "category", "confidence", "url", "domain", "hash", "recommendation", "excerpt")


def trace_text(trace: Column, *keys: str) -> Column:
    """The first of a trace's values that is there, as text; empty without one."""
    return F.coalesce(*[F.try_variant_get(trace, f"$.{k}", "string") for k in keys], F.lit(""))


def projection(results: DataFrame, scan_id: str = "", document_root: str = "") -> DataFrame:
    """All 35 columns of a report's finding rows. The trace is parsed once a finding, into a VARIANT from which its columns are read.

    Row ids hold a digest of the file's path and the finding's place in its list: a result has no number in a table."""
    whole = F.to_variant_object(F.struct(*[F.col(c) for c in ("file_path", "file_hash", "normalized_hash", "score", "severity", "status", "tags", "findings")]))
    rows = results.withColumn("scan_result", whole).select("*", F.posexplode("findings").alias("pos", "f")).withColumn("db_trace", F.coalesce(F.try_parse_json(F.col("f.trace")), F.parse_json(F.lit("{}"))))
    own = F.coalesce(F.nullif(F.col("f.fingerprint"), F.lit("")), fingerprint(F.col("file_path"), F.col("f.signature_id"), F.col("f.target"), F.col("f.excerpt"), document_root))
    tags = normal_tags(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("f.tags", F.array().cast("array<string>"))))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(
        F.concat(F.lit("finding_"), F.substring(F.md5("file_path"), 1, 16), F.lit("_"), F.col("pos").cast("string")).alias("id"), F.lit(scan_id).alias("scan_id"), text("file_path").alias("file_path"), text("file_hash").alias("file_hash"),
        text("normalized_hash").alias("normalized_hash"), own.alias("finding_fingerprint"), text("status").alias("status"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("f.severity", "severity", F.lit("")).alias("severity"),
        *[text(f"f.{c}").alias(c) for c in TEXTS], "f.entropy", "f.length", *[trace_text(F.col("db_trace"), *keys).alias(k) for k, keys in TRACE_COLUMNS.items()], "db_trace", tags.alias("tags"), "scan_result",
        F.to_variant_object(F.col("f").withField("fingerprint", own)).alias("finding"),
    )


def baseline_projection(results: DataFrame) -> DataFrame:
    """The seven columns of a baseline report's rows."""
    rows = results.select("file_path", "tags", F.posexplode("findings").alias("pos", "f"))
    none = F.array().cast("array<string>")
    return rows.select(
        F.concat(F.substring(F.md5("file_path"), 1, 16), F.lit("_"), F.col("pos").cast("string")).alias("ID"), F.coalesce("file_path", "f.file", F.lit("")).alias("FILE"), F.coalesce("f.signature_id", F.lit("")).alias("SIGNATURE"), F.coalesce("f.severity", F.lit("")).alias("SEVERITY"),
        F.coalesce("f.score", F.lit(0)).alias("SCORE"), F.array_distinct(F.concat(F.coalesce("tags", none), F.coalesce("f.tags", none))).alias("TAGS"), F.coalesce("f.excerpt", F.lit("")).alias("EXCERPT"),
    )


def by_tag(rows: DataFrame, tag: str) -> DataFrame:
    t = tag.strip().lower()
    return rows.where(F.array_contains("tags", t)) if t else rows


def sort_key(field: str) -> Column:
    if field == "tags":
        return F.array_join("tags", ",")
    return F.coalesce(F.col(field), F.lit(0)) if field in NUMERIC else F.coalesce(F.col(field), F.lit(""))


def ordered(rows: DataFrame, field: str = "score", descending: bool = True) -> DataFrame:
    """By one field, unknown ones by score; ties by file and place."""
    key = sort_key(field if field in SORTABLE else "score")
    return rows.orderBy(key.desc() if descending else key.asc(), "file_path", "pos")


@dataclass(frozen=True)
class Place:
    """Where a page ended: the last row's sort key, file and place in its list."""

    key: object
    file_path: str
    pos: int


def page_after(rows: DataFrame, field: str = "score", descending: bool = True, size: int = 50, after: Place | None = None) -> DataFrame:
    """The next ``size`` rows of :func:`ordered` behind a place, with their sort key as ``__key``. The rows before are not
    skipped but filtered out, and each task keeps no more than a page: a page costs the same wherever it lies."""
    key = sort_key(field if field in SORTABLE else "score")
    rows = rows.withColumn("__key", key)
    if after is not None:
        k = F.col("__key")
        beyond = k < F.lit(after.key) if descending else k > F.lit(after.key)
        tie = (k == F.lit(after.key)) & ((F.col("file_path") > after.file_path) | ((F.col("file_path") == after.file_path) & (F.col("pos") > after.pos)))
        rows = rows.where(beyond | tie)
    return rows.orderBy(F.col("__key").desc() if descending else F.col("__key").asc(), "file_path", "pos").limit(size)


def pages(rows: DataFrame, field: str = "score", descending: bool = True, size: int = 50):
    """The pages of a report one after the other, as lists of rows."""
    after = None
    while page := page_after(rows, field, descending, size, after).collect():  # at most a page
        yield page
        after = Place(page[-1]["__key"], page[-1]["file_path"], page[-1]["pos"])


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    return rows.offset(max(0, number - 1) * size).limit(size)


def exit_code(found: int, errors: int, conflict: bool = False) -> int:
    """0 ok, 1 findings, 3 runtime error, 4 conflict (2 is a usage error)."""
    return 4 if conflict else 3 if errors else 1 if found else 0
