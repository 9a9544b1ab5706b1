"""Known-hash database: normalization, feed import, prefix index, and the lookup join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.functions.hashes import file_hash
from palisade.schema import some, finding

# Severities and tags of imported feeds.
CATEGORY_TAGS = ("webshell", "backdoor", "malware", "phishing", "spam")
FEED_TAGS = ("known_malware", "panelica", "php_malware")
SHA256 = "^[a-f0-9]{64}$"


def normal_hash(c: Column) -> Column:
    return F.lower(F.trim(c))


#: What an item may hold besides its hash, and what stands for it (fixed values).
ITEM = {"name": "Known malware", "family": "", "category": "", "severity": "critical", "confidence": "high", "source": "malware_hashes", "source_ref": ""}


def database(items: DataFrame) -> DataFrame:
    """Valid items, the last of each hash: hash, the fields of :data:`ITEM` and tags. Severities beyond low..critical are critical."""
    order = F.col("ord") if "ord" in items.columns else F.monotonically_increasing_id()
    rows = items.withColumn("hash", normal_hash(F.col("hash"))).where(F.col("hash").rlike(SHA256)).withColumn("__o", order)
    text = {k: F.trim(F.coalesce(F.col(k).cast("string"), F.lit(v))) if k in items.columns else F.lit(v) for k, v in ITEM.items()}
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in items.columns else F.array().cast("array<string>")
    sev = F.lower(text["severity"])
    text["severity"] = F.when(sev.isin("low", "medium", "high", "critical"), sev).otherwise("critical")
    item = F.struct(*[v.alias(k) for k, v in text.items()], tags.alias("tags"))
    return rows.select("hash", "__o", item.alias("__i")).groupBy("hash").agg(F.max_by("__i", "__o").alias("__i")).select("hash", "__i.*")


def clamped(length: int) -> int:
    return min(12, max(8, length))


def prefixes(db: DataFrame, length: int = 8) -> DataFrame:
    return db.select(F.substring("hash", 1, clamped(length)).alias("prefix")).distinct()


# -- prefix index as bitmaps

#: Bits of a bitmap bucket (fixed by Spark's bitmap functions), and bits for each prefix.
BUCKET_BITS, BITS_PER_PREFIX = 32_768, 16
#: Buckets of 4 KiB that may be broadcast; more are joined by shuffle.
BROADCAST_BUCKETS = 2_048


@dataclass
class PrefixFilter:
    """Prefixes of one length and their bitmaps. An index without a valid prefix is off and passes everything."""

    length: int
    prefixes: DataFrame
    n_bits: int
    bitmaps: DataFrame

    @property
    def active(self) -> bool:
        return self.n_bits > 0


def bit(prefix: Column, n_bits: int) -> Column:
    """A prefix's bit: its value modulo the bits there are. Prefixes of a digest are even already."""
    return F.pmod(F.conv(prefix, 16, 10).cast("long"), F.lit(max(1, n_bits)))


def prefix_filter(index: DataFrame, length: int = 8) -> PrefixFilter:
    """From ``index(prefix)``: entries of other lengths or with other characters are left out."""
    length = clamped(length)
    valid = index.select(F.lower(F.trim("prefix")).alias("prefix")).where(F.col("prefix").rlike(f"^[a-f0-9]{{{length}}}$")).distinct()
    n = valid.count()
    n_bits = -(-n * BITS_PER_PREFIX // BUCKET_BITS) * BUCKET_BITS
    at = bit(F.col("prefix"), n_bits)
    bitmaps = valid.groupBy(F.floor(at / BUCKET_BITS).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(BUCKET_BITS))).alias("bitmap"))
    return PrefixFilter(length, valid, n_bits, bitmaps)


def bit_set(bitmap: Column, at: Column) -> Column:
    """Whether a bucket's bit is set; bytes and bits count from the low end."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) != 0


def may_contain(rows: DataFrame, index: PrefixFilter, hash_: str = "hash") -> DataFrame:
    """``rows`` with ``may_contain``: false where the hash's bit is not set, so that its prefix cannot be in the index."""
    if not index.active:
        return rows.withColumn("may_contain", F.lit(True))
    buckets = index.bitmaps.select(F.col("bucket").alias("__b"), "bitmap")
    if index.n_bits // BUCKET_BITS <= BROADCAST_BUCKETS:
        buckets = F.broadcast(buckets)
    keyed = rows.withColumn("__at", bit(F.substring(hash_, 1, index.length), index.n_bits))
    met = keyed.join(buckets, F.floor(F.col("__at") / BUCKET_BITS).cast("long") == F.col("__b"), "left")
    return met.withColumn("may_contain", F.coalesce(bit_set(F.col("bitmap"), F.pmod("__at", F.lit(BUCKET_BITS))), F.lit(False))).drop("__at", "__b", "bitmap")


def gated(rows: DataFrame, index: PrefixFilter | None, hash_: str = "hash") -> DataFrame:
    """Rows whose hash's prefix is in the index: those whose bit is set, and of these the ones that have the very prefix."""
    if index is None or not index.active:
        return rows
    few = may_contain(rows, index, hash_).where("may_contain").drop("may_contain")
    return few.withColumn("prefix", F.substring(hash_, 1, index.length)).join(index.prefixes, "prefix", "left_semi").drop("prefix")


def gate_counts(rows: DataFrame, index: PrefixFilter, hash_: str = "hash") -> DataFrame:
    """One row: hashes seen, and those that the bitmaps spare a lookup."""
    return may_contain(rows, index, hash_).agg(F.count("*").alias("hashes"), F.count_if(~F.col("may_contain")).alias("skipped"))


def matches(files: DataFrame, db: DataFrame, index: DataFrame | None = None, length: int = 8) -> DataFrame:
    """(path, hash, name, family, category, severity, ...). A prefix index that lacks a hash's prefix hides it; an empty one is off."""
    rows = files.select("path", file_hash(F.col("content")).alias("hash"))
    return gated(rows, None if index is None else prefix_filter(index, length)).join(db, "hash")


def known_finding(path: Column) -> Column:
    """The finding of a row joined with :func:`database`: always critical, score 100."""
    some_tags = F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: t != "")
    trace = F.to_json(F.struct("source", "hash", F.lit("sha256").alias("algorithm"), "family", "category", "source_ref", F.col("name").alias("matched_name"), F.col("severity").alias("matched_severity"), F.col("tags").alias("matched_tags"), F.lit("quarantine").alias("recommendation")))
    return finding(
        "known_malware_hash_match", name=F.col("name"), category="hash_db", severity="critical", score=100, excerpt=F.concat(F.substring("hash", 1, 16), F.lit("...")), target="file_hash", rule_type="hash", file=path, type="known_malware_hash", source=F.col("source"),
        hash=F.col("hash"), hash_algorithm="sha256", recommendation="quarantine", confidence=F.col("confidence"), trace=trace, tags=F.concat(F.array(F.lit("engine:hash_db"), F.lit("risk:known_malware_hash")), some_tags),
    )


def hash_findings(found: DataFrame) -> DataFrame:
    """(path, hash_findings) of :func:`matches`."""
    return found.select("path", some(known_finding(F.col("path"))).alias("hash_findings"))


def warning_finding(path: Column, message: str) -> Column:
    """What the first file of a scan gets when a database cannot be used; no risk by itself."""
    return finding(
        "hash_db_runtime_warning", name="Hash database runtime warning", category="hash_db", severity="info", score=0, excerpt=F.lit(message), target="hash_db", rule_type="hash_db", file=path, type="runtime_warning",
        source="hash_database", trace=F.to_json(F.struct(F.lit(message).alias("warning"))), tags=F.array(F.lit("engine:hash_db")),
    )


def scan_order(path: Column) -> Column:
    """Sorts as a depth-first scan by names goes: folders end before what follows their names."""
    return F.translate(path, "/", "\x01")


def first_path(files: DataFrame) -> str | None:
    """The first file of a scan of one root: one row, whatever the number of files."""
    return files.agg(F.min_by("path", scan_order(F.col("path"))).alias("path")).first()["path"]


@dataclass
class Known:
    """The known-hash side of a scan: a database or its warnings, and a prefix index."""

    db: DataFrame | None = None
    index: PrefixFilter | None = None
    warnings: tuple[str, ...] = ()
    #: The file that carries the warnings.
    first: str | None = None


def with_known(df: DataFrame, known: Known) -> DataFrame:
    """``df(path, file_hash, ...)`` with ``hash_findings``. Hashes meet the database, not paths: a row stays one row."""
    path, warned = F.col("path"), [F.when(F.col("path") == known.first, warning_finding(F.col("path"), w)) for w in known.warnings if known.first is not None]
    if known.db is None:
        return df.withColumn("hash_findings", some(*warned))
    db = gated(known.db, known.index).select("hash", F.struct("*").alias("__item"))
    item = df.join(db, F.col("file_hash") == F.col("hash"), "left").drop("hash").select("*", "__item.*").drop("__item")
    own = [c for c in df.columns]
    return item.withColumn("hash_findings", some(*warned, F.when(F.col("hash").isNotNull(), known_finding(path)))).select(*own, "hash_findings")


def import_feed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From feed rows (ord, hash, name, family, category, severity, tags): (items in hash order, counters).

    The first of each hash stays; counters are total, imported, invalid and duplicates."""
    h = normal_hash(F.col("hash"))
    valid = rows.withColumn("hash", h).withColumn("ok", F.coalesce(h.rlike(SHA256), F.lit(False)))
    ranked = valid.where("ok").withColumn("rn", F.row_number().over(Window.partitionBy("hash").orderBy("ord")))
    sev = F.lower(F.trim(F.coalesce("severity", F.lit(""))))
    cat = F.lower(F.trim(F.coalesce("category", F.lit(""))))
    own = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.regexp_replace(F.lower(F.trim(t)), "[^a-z0-9_:.-]+", "_"))
    extra = F.when(cat.isin(*CATEGORY_TAGS), F.array(cat)).otherwise(F.array().cast("array<string>"))
    tags = F.array_distinct(F.filter(F.concat(F.array(*map(F.lit, FEED_TAGS)), extra, own), lambda t: t != ""))
    blank = lambda c, d: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", d).otherwise(F.trim(c))
    items = ranked.where("rn = 1").select(
        "hash", blank("name", F.concat(F.lit("PHP.Malware."), F.substring("hash", 1, 12))).alias("name"), blank("family", F.lit("unknown")).alias("family"), blank("category", F.lit("malware")).alias("category"),
        F.when(sev == "medium", "high").otherwise("critical").alias("severity"), tags.alias("tags"),
    )
    counters = valid.agg(F.count("*").alias("total"), F.countDistinct(F.when(F.col("ok"), F.col("hash"))).alias("imported"), F.count_if(~F.col("ok")).alias("invalid")).withColumn(
        "duplicates", F.col("total") - F.col("imported") - F.col("invalid")
    )
    return items.orderBy("hash"), counters
