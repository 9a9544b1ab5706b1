"""URL analyzer: the one URL of a file, its context, and what it is used for.

As in the engine whose results these match, a file counts only if it holds exactly one URL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.hashes import collapsed
from palisade.functions.paths import basename
from palisade.operators.rules import java_pattern
from palisade.schema import FINDINGS, finding, no_findings, some

# Fixed values.
URL = "(?i)https?://[^\\s'\"<>()\\[\\]{}]+"
IFRAME = r"<iframe\b[^>]*\bsrc\s*="
SCRIPT = r"<script\b[^>]*\bsrc\s*="
LOADER = r"\b(curl_setopt|CURLOPT_URL|file_get_contents|fopen|readfile|include|include_once|require|require_once|fsockopen|stream_socket_client)\b"
REDIRECT = r"^\s*(RewriteRule|Redirect|RedirectMatch)\b"
SCORES = {"critical": 10, "high": 7, "medium": 4, "low": 2, "info": 0}


def url_info(content: Column) -> Column:
    """struct(url, domain, offset, line, line_text, context), null unless there is exactly one URL."""
    raw = F.regexp_extract(content, URL, 0)
    at = F.regexp_instr(content, F.lit(URL)) - 1
    url = F.rtrim(raw, F.lit(".,;'"))
    host = F.regexp_extract(url, "(?i)^https?://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    before, after = F.substr(content, F.lit(1), at), F.substr(content, at + 1)
    line_text = F.btrim(F.concat(F.substring_index(before, "\n", -1), F.substring_index(after, "\n", 1)), F.lit(" \t\n\r\0\x0b"))
    start = F.greatest(at - 240, F.lit(0))
    context = collapsed(F.substr(content, start + 1, at - start + F.length(raw) + 240))
    info = F.struct(
        url.alias("url"), F.lower(F.rtrim(host, F.lit("."))).alias("domain"), at.cast("long").alias("offset"), (F.regexp_count(before, F.lit("\n")) + 1).alias("line"),
        line_text.alias("line_text"), context.alias("context"),
    )
    return F.when(content.contains("://") & (F.regexp_count(content, F.lit(URL)) == 1) & (url != ""), info)


def _found(u: Column, path: Column, sig: str, severity, score, kind: str, tags, trace_more: dict[str, Column] | None = None) -> Column:
    excerpt = F.when(F.length(u["context"]) <= 180, u["context"]).otherwise(F.concat(F.substr(u["context"], F.lit(1), F.lit(150)), F.lit("...")))
    trace = F.to_json(F.struct(u["url"].alias("url"), u["domain"].alias("domain"), u["line_text"].alias("context"), u["line"].alias("line"), *[v.alias(k) for k, v in (trace_more or {}).items()]))
    tags = F.array(*map(F.lit, tags)) if isinstance(tags, list) else tags
    return finding(sig, category="url", severity=severity, score=score, offset=u["offset"], excerpt=excerpt, rule_type="url", file=path, line=u["line"], type=kind, source=kind, url=u["url"], domain=u["domain"], trace=trace, tags=tags)


def url_findings(path: Column, u: Column, match: Column | None = None) -> Column:
    """Findings from a column of :func:`url_info`; ``match`` is a struct(domain, severity, tags) or null."""
    ext, loader = ["engine:url", "risk:external_url"], ["engine:url", "risk:external_url", "risk:remote_loader"]
    either = lambda p: u["line_text"].rlike(java_pattern(p)) | u["context"].rlike(java_pattern(p))
    context = F.lower(u["context"])
    script = either(SCRIPT) | (context.contains("document.write") & context.contains("<script"))
    found = [_found(u, path, "external_url_detected", "info", 0, "external_url", ext)]
    if match is not None:
        score = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv]), match["severity"]), F.lit(0))
        tags = F.concat(F.array(*map(F.lit, loader)), F.transform(F.coalesce(match["tags"], F.array().cast("array<string>")), lambda t: F.concat(F.lit("domain:"), F.lower(F.trim(t)))))
        found.append(F.when(match.isNotNull(), _found(u, path, "suspicious_domain_match", match["severity"], score, "suspicious_domain", tags, {"matched_domain": match["domain"], "domain_tags": match["tags"]})))
    found += [
        F.when(either(IFRAME), _found(u, path, "suspicious_iframe_url", "high", 5, "iframe_url", loader)),
        F.when(script, _found(u, path, "external_script_injection", "high", 6, "external_script_injection", loader)),
        F.when(u["context"].rlike(java_pattern(LOADER)), _found(u, path, "remote_payload_loader", "high", 6, "remote_payload_loader", loader)),
        F.when((basename(path) == ".htaccess") & u["line_text"].rlike(java_pattern(REDIRECT)), _found(u, path, "htaccess_external_redirect", "high", 5, "htaccess_external_redirect", ext)),
    ]
    return F.when(u.isNotNull(), some(*found)).otherwise(no_findings()).cast(FINDINGS)


def domain_suffixes(domain: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(domain, "\\.")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))


def normal_domain(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^[a-z][a-z0-9+.-]*://", ""), "[/:].*$", ""), F.lit("."))


def plain_domain(text: str) -> str:
    """:func:`normal_domain` of one entry of a list on the driver."""
    bare = re.sub(r"^https?://", "", text.strip().lower())
    return re.sub(r"(?s)[/:].*$", "", bare).strip(". \t\r\n")


def match_domains(urls: DataFrame, domains: DataFrame, key: str = "path") -> DataFrame:
    """(key, match struct) for rows with a ``domain`` that the list holds, exactly or by a parent.

    ``domains``: (ord, domain, severity, tags). An exact hit wins, else the list's first suffix. The join is an
    equi-join on suffixes, so it neither multiplies the list nor scans it for each row."""
    rows = urls.select(key, F.col("domain").alias("__own"), F.explode(domain_suffixes(F.col("domain"))).alias("domain")).where("domain <> ''")
    hit = rows.join(domains, "domain")
    order = F.struct((F.col("domain") != F.col("__own")).alias("a"), F.col("ord").alias("b"))
    return hit.groupBy(key).agg(F.min_by(F.struct("domain", "severity", "tags"), order).alias("match"))
