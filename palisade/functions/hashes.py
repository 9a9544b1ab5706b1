"""Content hashes and finding fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.config import ScanConfig
from palisade.functions.paths import is_binary

SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def normalized_hash(content: Column, config: ScanConfig = ScanConfig()) -> Column:
    """SHA-256 of the content without white space; null if switched off, too large, binary or with a NUL."""
    if not config.normalized_hash:
        return F.lit(None).cast("string")
    fits = (F.octet_length(content) <= config.normalized_hash_max_mb << 20) & ~is_binary(content) & ~content.contains("\x00")
    return F.when(fits, F.sha2(F.regexp_replace(content, SPACE, ""), 256))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def fingerprint_path(path: Column, document_root: str = "") -> Column:
    tidy = lambda s: F.lower(F.rtrim(F.regexp_replace(F.replace(F.trim(s), F.lit("\\"), F.lit("/")), "/+", "/"), F.lit("/")))
    p, root = tidy(path), document_root.strip().replace("\\", "/").rstrip("/").lower()
    if not root:
        return p
    return F.when(p == root, "/").when(F.startswith(p, F.lit(root + "/")), F.concat(F.lit("/"), F.ltrim(F.substring(p, len(root) + 1, 1 << 30), F.lit("/")))).otherwise(p)


def excerpt_hash(excerpt: Column) -> Column:
    return F.sha2(F.substring(collapsed(F.coalesce(excerpt, F.lit(""))), 1, 512), 256)


def fingerprint(path: Column, signature_id: Column, target: Column, excerpt: Column, document_root: str = "") -> Column:
    """Stable identity of a finding across document roots."""
    t = F.lower(F.trim(F.coalesce(target, F.lit(""))))
    parts = [fingerprint_path(path, document_root), F.lower(F.trim(F.coalesce(signature_id, F.lit("")))), F.when(t == "", "content").otherwise(t), excerpt_hash(excerpt)]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def shannon(text: Column) -> Column:
    """Bits for each character; '' gives 0."""
    n = F.length(text).cast("double")
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(F.length(text) == 0, 0.0).otherwise(F.aggregate(shares, F.lit(0.0), lambda a, p: F.when(p > 0, a - p * F.log2(p)).otherwise(a)))
