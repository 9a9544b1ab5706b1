"""Scans of a tree's rows, as the ``sitefiles`` source gives them: one result a file, large files included.

Files over the size limit arrive in chunks that overlap. Each chunk is analyzed for itself; its findings move to their place in the
file, and of those that neighbours share, or that a rule made more than once, the first in the file stays, with its
surroundings whole: what a scan of the whole content would have found, as far as a match and its surroundings fit in the
overlap. Sums by (file, finding) combine within tasks, so no task holds a file's chunks together. The file's
hash comes from the reader, which takes it while it reads.

Of a chunked file entropy runs and .htaccess lines are judged chunk by chunk, and its code is not parsed; it has no normalized hash.
A file that could not be read is a result with status ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import ScanConfig
from palisade.operators.findings import analyzed, concluded, fenced, with_fields
from palisade.operators.hashdb import Known, with_known
from palisade.operators.rules import RULES, rule_findings
from palisade.operators.urls import URL, match_domains, url_info
from palisade.schema import FINDING, FINDINGS, no_findings

#: Characters of a rule's excerpt before and after the start of its match (fixed values).
BEFORE, AFTER = 60, 100
RESULT = ("file_path", "file_hash", "normalized_hash", "findings", "score", "severity", "status", "tags")


def is_short(at: Column, before: int, after: int) -> Column:
    """1 if the surroundings of a place in a chunk are cut by its ends, and the file goes on there."""
    cut = ((at < before) & (F.col("chunk_index") > 0)) | ((at + after > F.col("n_chars")) & ~F.col("last"))
    return cut.cast("int")


def chunk_items(rules) -> Column:
    """What a chunk has to say: array<struct<key, ord, at, short, f>>, and one item without a key."""
    order = {r.id: i for i, r in enumerate(rules)}
    ids = F.array(*map(F.lit, order))

    def item(f):
        single = F.array_contains(ids, f["signature_id"])
        lines = f["category"] == "htaccess"  # their offsets are lines
        at = f["offset"] + F.when(lines, F.col("start_line")).otherwise(F.col("start"))
        moved = with_fields(f, offset=at)
        key = F.when(single, f["signature_id"]).otherwise(F.concat_ws(":", f["signature_id"], at.cast("string"), F.sha1(F.coalesce(f["excerpt"], F.lit("")))))
        place = F.when(single, F.array_position(ids, f["signature_id"])).otherwise(F.lit(len(order) + 1))
        return F.struct(key.alias("key"), place.cast("int").alias("ord"), at.alias("at"), is_short(f["offset"], BEFORE, AFTER).alias("short"), moved.cast(FINDING).alias("f"))

    none = F.struct(F.lit("").alias("key"), F.lit(0).alias("ord"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("short"), F.lit(None).cast(FINDING).alias("f"))
    return F.concat(F.array(none), F.transform("__after", item))


def chunks_folded(rows: DataFrame, config: ScanConfig, rules=RULES) -> DataFrame:
    """Chunk rows as one row a file with the columns of :func:`analyzed`, and the file's error if a chunk has one."""
    own = ("chunk_index", "start", "start_line", "last", "sha256", "n_chars", "n_urls", "error")
    rows = rows.withColumn("n_chars", F.length("content")).withColumn("n_urls", F.regexp_count("content", F.lit(URL)))
    df = analyzed(rows, config, [r for r in rules if r.pattern is not None], False, False, own)
    url = F.col("__u") if config.urls else F.lit(None).cast("struct<url:string,domain:string,offset:bigint,line:int,line_text:string,context:string>")
    at = url["offset"] + F.col("start")
    whole = F.when(url.isNotNull(), F.struct(url["url"].alias("url"), url["domain"].alias("domain"), at.alias("offset"), (url["line"] + F.col("start_line")).cast("int").alias("line"), url["line_text"].alias("line_text"), url["context"].alias("context")))
    df = fenced(df, items=chunk_items(rules), u=whole, u_order=F.when(url.isNotNull(), F.struct(-is_short(url["offset"], 240, F.length(url["url"]) + 240), F.length(url["context"]))))
    items = df.select("path", "sha256", "n_urls", "u", "u_order", "error", F.explode("items").alias("i"))
    once = items.groupBy("path", "i.key").agg(
        F.min_by("i", F.struct("i.at", "i.short")).alias("i"), F.max("sha256").alias("sha256"), F.max("n_urls").alias("n_urls"), F.min("u.offset").alias("u0"), F.max("u.offset").alias("u1"), F.max_by("u", "u_order").alias("u"), F.max("error").alias("error"),
    )
    bare = F.col("i.key") == ""
    one = lambda c, f=F.max: f(F.when(bare, F.col(c))).alias(c)
    files = once.groupBy("path").agg(
        F.sort_array(F.collect_list(F.when(~bare, F.struct("i.ord", "i.at", "i.f")))).alias("found"), one("sha256"), one("n_urls"), one("u0"), one("u1"), F.max_by("u", bare.cast("int")).alias("u"), F.max("error").alias("error"),
    )
    single = (F.col("n_urls") == 1) & (F.col("u0") == F.col("u1"))
    before = rule_findings(F.col("path"), F.lit(""), [r for r in rules if r.pattern is None]).cast(FINDINGS)
    out = files.select("path", F.col("sha256").alias("file_hash"), F.lit(None).cast("string").alias("normalized_hash"), "error", before.alias("__before"), F.transform("found", lambda x: x["f"]).cast(FINDINGS).alias("__after"), F.when(single, F.col("u")).alias("__u"))
    return out if config.urls else out.drop("__u")


def tree_scanned(rows: DataFrame, config: ScanConfig = ScanConfig(), rules=RULES, known: Known | None = None, domains: DataFrame | None = None, code: bool = False, large: DataFrame | None = None) -> DataFrame:
    """One result for each file of the source's rows: the columns of :data:`RESULT` and ``error``. Whole and chunked files go apart: ``rows``
    is read twice, unless ``large`` has the chunked ones, read for themselves."""
    small = analyzed(rows.where("chunked = false"), config, rules, code, True, ("sha256", "error")).withColumn("file_hash", F.col("sha256")).drop("sha256")
    df = small.unionByName(chunks_folded((rows if large is None else large).where("chunked = true"), config, rules))
    bad, clear = F.col("error").isNotNull(), no_findings()
    df = df.withColumns({c: F.when(bad, clear).otherwise(F.col(c)) for c in ("__before", "__after")})
    if config.urls:
        df = df.withColumn("__u", F.when(~bad, F.col("__u")))
    if domains is not None and config.urls:
        df = with_domains(df, domains)
    if known is not None and config.hash_db:
        df = with_known(df, known)
    df = concluded(df, config, ("error",), domains is not None)
    return df.withColumn("status", F.when(bad, "error").otherwise(F.col("status"))).select(*RESULT, "error")


def with_domains(df: DataFrame, domains: DataFrame) -> DataFrame:
    """``match`` of each row's URL: its distinct domains meet the list, and rows meet their domains."""
    df = df.withColumn("__d", F.col("__u.domain"))
    seen = df.select(F.col("__d").alias("__domain"), F.col("__d").alias("domain")).where("domain IS NOT NULL").distinct()
    met = match_domains(seen, domains, "__domain")
    return df.join(met, F.col("__d") == F.col("__domain"), "left").drop("__d", "__domain")
