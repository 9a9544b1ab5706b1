"""Findings of a file: dedupe, tags, fingerprints, score, severity, verdict. All within the file's row, so no row moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import AST_EXTENSIONS, ScanConfig
from palisade.functions.hashes import file_hash, fingerprint, normalized_hash
from palisade.functions.paths import extension, path_tags
from palisade.operators.entropy import entropy_findings
from palisade.operators.hashdb import Known, with_known
from palisade.operators.htaccess import htaccess_findings
from palisade.operators.rules import RULES, rule_findings
from palisade.operators.urls import match_domains, url_findings, url_info
from palisade.schema import FIELDS, FINDINGS, let, no_findings, severity_of, weight, with_values

#: Category to engine tag (fixed values).
ENGINES = {"php_ast": "engine:ast", "taint": "engine:taint", "php_taint": "engine:taint", "htaccess": "engine:htaccess", "entropy": "engine:entropy", "url": "engine:url", "hash_db": "engine:hash_db", "webshell_fingerprint": "engine:fingerprint", "baseline": "engine:baseline", "bitrix_db": "engine:bitrix_db", "core_integrity": "engine:core_integrity"}
TARGETS = {"db_agent": "entity:db_agent", "db_event": "entity:db_event", "db_template_condition": "entity:db_template_condition", "db_trigger": "entity:db_trigger"}


def dedupe_key(f: Column) -> Column:
    """Null for findings that are never merged; the id alone without offset and excerpt."""
    bare = f["offset"].isNull() & (F.coalesce(f["excerpt"], F.lit("")) == "")
    whole = F.concat_ws(":", f["signature_id"], f["target"], f["rule_type"], F.coalesce(f["offset"].cast("string"), F.lit("")), F.sha1(F.coalesce(f["excerpt"], F.lit(""))))
    return F.when(f["signature_id"] == "", F.lit(None)).when(bare, f["signature_id"]).otherwise(whole)


def deduped(findings: Column, key=dedupe_key) -> Column:
    """The first of each key, in order; findings without a key stay. One sort of (key, place), and one of the places
    that stand first of their keys, so the work of a file grows with n log n of its findings."""

    def first_places(pairs):
        firsts = F.filter(pairs, lambda x, j: (j == 0) | (F.get(pairs, j - 1)["k"] != x["k"]))
        return F.array_sort(F.transform(firsts, lambda x: x["i"]))

    def of(fs):
        own = lambda f, i: F.struct(F.coalesce(key(f), F.concat(F.lit("\x00"), i.cast("string"))).alias("k"), i.alias("i"))
        return F.transform(let(F.array_sort(F.transform(fs, own)), first_places), lambda i: F.get(fs, i))

    return let(findings, of)


def normal_tags(tags: Column) -> Column:
    """Lower-case, trimmed, distinct, in byte order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")))


def finding_tags(f: Column) -> Column:
    """The finding's own tags and those of its kind. What the tests read of it is lowered once."""
    read = F.struct(*[F.lower(F.coalesce(f[x], F.lit(""))).alias(x) for x in ("category", "target", "rule_type", "signature_id")])
    return let(read, lambda x: tags_by_kind(f, x))


def tags_by_kind(f: Column, read: Column) -> Column:
    c, t, k, s = (read[x] for x in ("category", "target", "rule_type", "signature_id"))
    has = lambda *words: F.greatest(*[s.contains(w) for w in words]) if len(words) > 1 else s.contains(words[0])
    taint = c.isin("taint", "php_taint")
    pairs = [(c == a, b) for a, b in ENGINES.items()] + [(k.isin("regex", "path"), "engine:regex")]
    pairs += [(t == a, b) for a, b in TARGETS.items()] + [(t.isin(*TARGETS), "engine:bitrix_db")]
    pairs += [
        (has("dangerous_call", "request_to_"), "risk:dangerous_sink"),
        (has("encoded", "base64", "gzinflate"), "risk:encoded_payload"),
        (taint | has("request") | F.coalesce(f["trace"].rlike('(?i)"source":"[^"]*\\$_(?:GET|POST|REQUEST|COOKIE)(?![A-Za-z0-9_])'), F.lit(False)), "risk:request_input"),
        (has("dynamic", "callable"), "risk:dynamic_call"),
        (has("file_put_contents", "fwrite", "file_write"), "risk:file_write"),
        (s == "htaccess_php_handler_for_static_ext", "risk:htaccess_handler"),
        (s == "htaccess_auto_prepend_append", "risk:persistence"),
        (c == "webshell_fingerprint", "risk:webshell_fingerprint"),
        ((c == "hash_db") & (s != "hash_db_runtime_warning"), "risk:known_malware_hash"),
        (c == "entropy", "risk:entropy"),
        (c == "url", "risk:external_url"),
        ((c == "url") & has("remote_payload_loader", "external_script_injection"), "risk:remote_loader"),
        (c == "baseline", "risk:baseline_change"),
        (c == "core_integrity", "risk:modified_core"),
    ]
    made = F.array_compact(F.array(*[F.when(cond, tag) for cond, tag in pairs]))
    return normal_tags(F.concat(F.coalesce(f["tags"], F.array().cast("array<string>")), made))


def with_fields(f: Column, **values: Column) -> Column:
    return with_values(f, {k: v.cast(FIELDS[k]) for k, v in values.items()})


def tagged(findings: Column, path: Column, document_root: str = "") -> Column:
    """Findings with their tags and fingerprints."""
    return F.transform(findings, lambda f: with_fields(f, tags=finding_tags(f), fingerprint=fingerprint(path, f["signature_id"], f["target"], f["excerpt"], document_root)))


def score(findings: Column) -> Column:
    return F.aggregate(findings, F.lit(0), lambda a, f: a + f["score"])


def severity(findings: Column) -> Column:
    """The heaviest; low without findings."""
    return severity_of(F.aggregate(findings, F.when(F.size(findings) == 0, F.lit(1)).otherwise(F.lit(0)), lambda a, f: F.greatest(a, weight(f["severity"]))))


def verdict(total: Column, thresholds: tuple[int, int]) -> Column:
    return F.when(total >= thresholds[1], "malicious").when(total >= thresholds[0], "suspicious").when(total > 0, "low_risk").otherwise("clean")


def has_risk(findings: Column) -> Column:
    return F.exists(findings, lambda f: f["score"] > 0)


def result_tags(path: Column, findings: Column, existing: Column | None = None) -> Column:
    own = F.concat(path_tags(path), F.flatten(F.transform(findings, lambda f: F.coalesce(f["tags"], F.array().cast("array<string>")))))
    return normal_tags(F.concat(own, existing) if existing is not None else own)


def summed(df: DataFrame, config: ScanConfig = ScanConfig(), existing_tags: str | None = None) -> DataFrame:
    """Score, severity, status and tags from the ``findings`` column."""
    df = df.withColumn("score", score(F.col("findings"))).withColumn("severity", severity(F.col("findings")))
    return df.withColumn("status", verdict(F.col("score"), config.thresholds)).withColumn("tags", result_tags(F.col("file_path"), F.col("findings"), F.col(existing_tags) if existing_tags else None))


def fenced(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: what stands above reads them, and does not copy their expressions."""
    own = [c for c in df.columns if c not in values]
    row = F.struct(*[v.alias(k) for k, v in values.items()])
    return df.select(*own, F.explode(F.array(row)).alias("__row")).select(*own, "__row.*")


def analyzed(files: DataFrame, config: ScanConfig, rules, code: bool, paths: bool, keep: tuple[str, ...]) -> DataFrame:
    """``files(path, content)`` with hashes, the findings before and after those of known hashes, and the URL; without contents."""
    from palisade.operators.code import with_code_findings

    df = files.select("path", "content", *keep)
    if code and config.ast:
        df = with_code_findings(df, config)
    p, c = F.col("path"), F.col("content")
    after = [rule_findings(p, c, [r for r in rules if r.pattern is not None], config.prefilter)]
    if code and config.ast:
        after.append(F.when(extension(p).isin(AST_EXTENSIONS) & (F.octet_length(c) <= config.ast_max_bytes), F.col("code_findings")).otherwise(no_findings()))
    after.append(htaccess_findings(p, c))
    if config.entropy_enabled():
        after.append(entropy_findings(p, c, config.entropy_min_length, config.entropy_threshold, config.entropy_window))
    parts = {"__before": rule_findings(p, c, [r for r in rules if r.pattern is None], paths=paths).cast(FINDINGS), "__after": F.concat(*[x.cast(FINDINGS) for x in after])}
    if config.urls:
        parts["__u"] = url_info(c)
    return fenced(df.withColumns({"file_hash": file_hash(c), "normalized_hash": normalized_hash(c, config)}), **parts).drop("content", "code_findings")


def concluded(df: DataFrame, config: ScanConfig, keep: tuple[str, ...] = (), match: bool = False) -> DataFrame:
    """Verdicts from the columns of :func:`analyzed`, with ``hash_findings`` and the domain ``match`` where they are there."""
    known = [F.col("__before")]
    if "hash_findings" in df.columns:
        known.append(F.coalesce(F.col("hash_findings"), no_findings()).cast(FINDINGS))
    known.append(F.col("__after"))
    if config.urls:
        known.append(url_findings(F.col("path"), F.col("__u"), F.col("match") if match else None).cast(FINDINGS))
    df = df.select(F.col("path").alias("file_path"), "file_hash", "normalized_hash", *keep, F.concat(*known).alias("findings"))
    df = fenced(df, findings=deduped(F.col("findings")))
    df = fenced(df, findings=tagged(F.col("findings"), F.col("file_path"), config.document_root))
    return summed(df, config)


def scanned(files: DataFrame, config: ScanConfig = ScanConfig(), rules=RULES, hash_findings: DataFrame | None = None, domains: DataFrame | None = None, code: bool = False, paths: bool = True, keep: tuple[str, ...] = (), known: Known | None = None) -> DataFrame:
    """Verdicts of ``files(path, content)``: a row for each, with all findings in analyzer order, and the columns ``keep``.

    Map-only unless a hash or domain list is given. ``known`` meets the files by their hashes, in the same
    pass; ``hash_findings`` (path, hash_findings) and ``domains`` by path when the content has been left behind. ``code`` adds the source-code analyzers."""
    df = analyzed(files, config, rules, code, paths, keep)
    if domains is not None and config.urls:
        seen = files.select("path", url_info(F.col("content")).alias("__u")).where("__u IS NOT NULL").select("path", F.col("__u.domain").alias("domain"))
        df = df.join(match_domains(seen, domains), "path", "left")
    if known is not None and config.hash_db:
        df = with_known(df, known)
    elif hash_findings is not None and config.hash_db:
        df = df.join(hash_findings, "path", "left")
    return concluded(df, config, keep, domains is not None)
