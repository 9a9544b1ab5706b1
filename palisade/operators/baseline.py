"""Baseline snapshots and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import ScanConfig
from palisade.functions.hashes import file_hash, normalized_hash
from palisade.functions.paths import basename, extension, relative
from palisade.operators.findings import summed, tagged
from palisade.schema import FINDINGS, finding, some

# Fixed values.
CRITICAL_FILES = ("/bitrix/php_interface/init.php", "/local/php_interface/init.php")
CRITICAL_PREFIXES = ("/bitrix/admin/", "/bitrix/tools/", "/upload/", "/local/modules/", "/bitrix/modules/")
UPLOAD_PHP = "php php3 php4 php5 php7 php8 phtml pht".split()
CRITICAL_IDS = ("baseline_critical_path_changed", "baseline_php_in_upload", "baseline_unknown_file_in_tools")


def snapshot(files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """(path, relative_path, size, mtime, sha256, normalized_hash); all extensions are tracked."""
    c = F.col("content")
    mtime = F.col("mtime").cast("long") if "mtime" in files.columns else F.lit(0).cast("long")
    rel = relative(F.col("path"), config.document_root, config.scan_paths)
    return files.where(F.octet_length(c) <= config.max_file_mb << 20).select("path", rel.alias("relative_path"), F.octet_length(c).cast("long").alias("size"), mtime.alias("mtime"), file_hash(c).alias("sha256"), normalized_hash(c, config).alias("normalized_hash"))


def tree_snapshot(rows: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """:func:`snapshot` of the ``sitefiles`` source's rows: the last row of each file has its hash, large files included."""
    rel = relative(F.col("path"), config.document_root, config.scan_paths)
    kept = rows.where("last AND error IS NULL")
    return kept.select("path", rel.alias("relative_path"), F.col("length").alias("size"), F.col("mtime").cast("long").alias("mtime"), "sha256", F.when(~F.col("chunked"), normalized_hash(F.col("content"), config)).alias("normalized_hash"))


def critical(rel: Column) -> Column:
    p = F.lower(rel)
    out = p.isin(*CRITICAL_FILES) | (basename(p) == ".htaccess")
    for prefix in CRITICAL_PREFIXES:
        out = out | p.startswith(prefix)
    return out


def php_in_upload(rel: Column) -> Column:
    return F.lower(rel).startswith("/upload/") & extension(rel).isin(*UPLOAD_PHP)


def admin_or_tools(rel: Column) -> Column:
    return F.lower(rel).startswith("/bitrix/tools/") | F.lower(rel).startswith("/bitrix/admin/")


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(relative_path, change, normalized_hash_changed, ...) of all paths that differ: one full outer equi-join."""
    def side(df, p):
        keyed = df.select(F.lower("relative_path").alias("key"), F.struct("path", "relative_path", "size", "mtime", "sha256", "normalized_hash").alias(p))
        # the last of equal keys wins, in path order
        return keyed.groupBy("key").agg(F.max_by(p, F.col(f"{p}.path")).alias(p))

    df = side(old, "a").join(side(new, "b"), "key", "full_outer")
    differs = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    sha = (F.col("a.sha256") != "") & (F.col("b.sha256") != "") & differs("sha256")
    norm = F.col("a.normalized_hash").isNotNull() & F.col("b.normalized_hash").isNotNull() & differs("normalized_hash")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(sha | differs("size") | norm, "modified")
    now = F.coalesce("b", "a")
    return df.withColumn("change", change).where("change IS NOT NULL").select(
        now["path"].alias("path"), now["relative_path"].alias("relative_path"), "change", (F.col("a.normalized_hash") != F.col("b.normalized_hash")).alias("normalized_hash_changed"),
        F.col("a.sha256").alias("old_sha256"), F.col("b.sha256").alias("sha256"), F.col("a.size").alias("old_size"), F.col("b.size").alias("size"),
    )


def results(diff: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """A scored result for each changed file."""
    rel, change = F.col("relative_path"), F.col("change")
    trace = F.to_json(F.struct("relative_path", "change", "old_sha256", "sha256", "normalized_hash_changed"))
    made = lambda sig, severity, score: finding(sig, category="baseline", severity=severity, score=score, excerpt=rel, target="baseline", rule_type="baseline", file=F.col("path"), type="baseline", source="baseline", trace=trace)
    found = some(
        F.when(change == "new", made("baseline_new_file", "medium", 3)).when(change == "modified", made("baseline_modified_file", "medium", 4)).otherwise(made("baseline_deleted_file", "medium", 3)),
        F.when(critical(rel), made("baseline_critical_path_changed", "high", 5)),
        F.when((change == "new") & php_in_upload(rel), made("baseline_php_in_upload", "critical", 9)),
        F.when((change == "new") & admin_or_tools(rel), made("baseline_unknown_file_in_tools", "high", 7)),
    )
    df = diff.select(F.col("path").alias("file_path"), "relative_path", "change", "normalized_hash_changed", F.coalesce("sha256", "old_sha256").alias("file_hash"), found.alias("findings"))
    df = df.withColumn("findings", tagged(F.col("findings"), F.col("file_path"), config.document_root).cast(FINDINGS))
    return summed(df, config)


def counts(res: DataFrame) -> DataFrame:
    """One row: findings_total, new, modified, deleted, critical (a count of files)."""
    grave = F.exists("findings", lambda f: f["severity"].isin("high", "critical") | f["signature_id"].isin(*CRITICAL_IDS))
    return res.agg(
        F.coalesce(F.sum(F.size("findings")), F.lit(0)).cast("long").alias("findings_total"), *[F.count_if(F.col("change") == c).alias(f"{c}_files") for c in ("new", "modified", "deleted")], F.count_if(grave).alias("critical_changes")
    )
