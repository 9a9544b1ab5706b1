"""The query catalogue of the scanner, with DuckDB SQL for what SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.config import DEEP_EXTENSIONS, STANDARD_EXTENSIONS, THRESHOLDS, ScanConfig
from palisade.functions import paths
from palisade.functions.hashes import excerpt_hash, file_hash, fingerprint, normalized_hash, shannon
from palisade.operators import baseline, hashdb, htaccess, report, tables, whitelist
from palisade.operators.entropy import candidates, entropy_findings
from palisade.operators.findings import fenced, has_risk, scanned
from palisade.operators.htaccess import htaccess_findings, lines, rewrites
from palisade.operators.rules import RULES, passes_prefilter, rule_finding, rule_findings
from palisade.operators.urls import match_domains, url_findings, url_info
from palisade.plans import overlay as O
from palisade.plans.overlay import lit, sql_files
from palisade.schema import let

QUERIES, ORACLES = {}, {}
CONFIG = ScanConfig.of(document_root="/site", entropy=True)
EXT = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\.([^.]*)$', 1))"
FILES = f"WITH files AS ({sql_files()})"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def files(spark: SparkSession, sf: str, edit: str = "") -> DataFrame:
    return O.site_files(spark, sf, edit)


# -- rules


def sql_path_test(r) -> str:
    tests = [f"strpos(lower(path), {lit(r.path_contains.lower())}) > 0"] if r.path_contains else []
    tests += [f"ends_with(lower(path), {lit(r.path_equals.lower())})"] if r.path_equals else []
    tests += [f"{EXT} IN ({', '.join(map(lit, r.extensions))})"] if r.extensions else []
    return " AND ".join(tests) or "true"


def sql_rule(r) -> str:
    """Whether a rule fires; the prefilter cannot change that for these rules."""
    if r.pattern is None:
        return sql_path_test(r)
    return f"({sql_path_test(r)}) AND regexp_matches(content, {lit('(?' + r.flags + ')' + r.pattern if r.flags else r.pattern)})"


def sql_all_rules() -> str:
    rows = " UNION ALL ".join(f"SELECT path, {lit(r.id)} AS signature_id, {lit(r.severity)} AS severity, {r.score} AS score FROM files WHERE {sql_rule(r)}" for r in RULES)
    return f"{FILES}, found AS ({rows})"


SUMS = """, sums AS (SELECT f.path, coalesce(sum(found.score), 0)::INT AS score, coalesce(max(CASE found.severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 WHEN 'info' THEN 0 END), 1) AS w
  FROM files f LEFT JOIN found USING (path) GROUP BY f.path, f.doc_id)"""


def _rule_query(r):
    if r.pattern is None:
        sql = f"{FILES} SELECT path, NULL::BIGINT AS at FROM files WHERE {sql_rule(r)}"
    else:
        p = lit("(?" + r.flags + ")" + r.pattern if r.flags else r.pattern)
        sql = f"{FILES} SELECT path, (strpos(content, regexp_extract(content, {p})) - 1)::BIGINT AS at FROM files WHERE {sql_rule(r)}"

    @query(f"rule_{r.id}", sql)
    def run(spark, sf):
        df = fenced(files(spark, sf), f=let(F.lower("content"), lambda lower: rule_finding(r, F.col("path"), F.col("content"), lower)))
        return df.where("f IS NOT NULL").select("path", F.col("f.offset").alias("at"))


for _r in RULES:
    _rule_query(_r)


@query("rule_findings", sql_all_rules() + " SELECT path, signature_id, severity, score FROM found")
def q_rule_findings(spark, sf):
    df = files(spark, sf).select("path", F.explode(rule_findings(F.col("path"), F.col("content"))).alias("f"))
    return df.select("path", "f.signature_id", "f.severity", "f.score")


@query("path_rule_findings", f"{FILES} SELECT path FROM files WHERE {sql_rule(next(r for r in RULES if r.pattern is None))}")
def q_path_rules(spark, sf):
    only = [r for r in RULES if r.pattern is None]
    return files(spark, sf).where(F.size(rule_findings(F.col("path"), F.col("content"), only)) > 0).select("path")


for _mode in ("any", "all"):
    _rule = next(r for r in RULES if r.mode == _mode and len(r.strings) > 1)

    def _pre(rule):
        def run(spark, sf):
            return fenced(files(spark, sf), lower=F.lower("content")).where(passes_prefilter(rule, F.col("lower"))).select("path")

        return run

    _join = " AND " if _mode == "all" else " OR "
    query(f"prefilter_{_mode}", f"{FILES} SELECT path FROM files WHERE {_join.join(f'strpos(lower(content), {lit(s.lower())}) > 0' for s in _rule.strings)}")(_pre(_rule))


def rule_results(spark, sf, config=CONFIG):
    from palisade.operators.findings import summed

    df = fenced(files(spark, sf).withColumnRenamed("path", "file_path"), findings=rule_findings(F.col("file_path"), F.col("content")))
    return summed(df.select("file_path", "findings"), config)


@query("file_scores", sql_all_rules() + SUMS + " SELECT path AS file_path, score FROM sums")
def q_scores(spark, sf):
    return rule_results(spark, sf).select("file_path", "score")


@query("file_severity", sql_all_rules() + SUMS + " SELECT path AS file_path, (['info', 'low', 'medium', 'high', 'critical'])[w + 1] AS severity FROM sums")
def q_severity(spark, sf):
    return rule_results(spark, sf).select("file_path", "severity")


for _p, (_s, _m) in THRESHOLDS.items():

    def _verdicts(profile):
        def run(spark, sf):
            return rule_results(spark, sf, ScanConfig.of(profile=profile)).select("file_path", "status")

        return run

    query(f"file_verdict_{_p}", sql_all_rules() + SUMS + f" SELECT path AS file_path, CASE WHEN score >= {_m} THEN 'malicious' WHEN score >= {_s} THEN 'suspicious' WHEN score > 0 THEN 'low_risk' ELSE 'clean' END AS status FROM sums")(_verdicts(_p))


@query("finding_dedupe", f"{FILES} SELECT path, 2 AS n_before, 1 AS n_after FROM files WHERE {sql_rule(RULES[0])}")
def q_dedupe(spark, sf):
    from palisade.operators.findings import deduped

    twice = rule_findings(F.col("path"), F.col("content"), [RULES[0], RULES[0]])
    df = fenced(files(spark, sf), f=twice).where(F.size("f") > 0)
    return df.select("path", F.size("f").alias("n_before"), F.size(deduped(F.col("f"))).alias("n_after"))


# -- paths

_EXCLUDES = ("/site/s1/upload", "/site/s2/bitrix/cache", "/SITE/s3/")
QUICK = ScanConfig.of(document_root="/site/s0", scan_profile="quick")


@query("exclude_filter", f"{FILES} SELECT path FROM files WHERE NOT ({' OR '.join(f'lower(path) = {lit(e)} OR starts_with(lower(path), {lit(e + '/')})' for e in ('/site/s1/upload', '/site/s2/bitrix/cache', '/site/s3'))})")
def q_exclude(spark, sf):
    return O.site_paths(spark, sf).where(~paths.excluded(F.col("path"), _EXCLUDES)).select("path")


for _n, _e in (("standard", STANDARD_EXTENSIONS), ("deep", DEEP_EXTENSIONS)):

    def _ext(profile):
        def run(spark, sf):
            return O.site_paths(spark, sf).where(paths.allowed(F.col("path"), ScanConfig.of(scan_profile=profile))).select("path")

        return run

    query(f"extension_filter_{_n}", f"{FILES} SELECT path FROM files WHERE {EXT} IN ({', '.join(map(lit, _e))})")(_ext(_n))


@query("quick_profile_paths", f"{FILES} SELECT path FROM files WHERE {' OR '.join(f'starts_with(lower(path), {lit(r + '/')})' for r in QUICK.roots())}")
def q_quick(spark, sf):
    return O.site_paths(spark, sf).where(paths.in_roots(F.col("path"), QUICK)).select("path")


@query("binary_sniff", f"{FILES} SELECT path FROM files WHERE starts_with(content, chr(127) || 'ELF')")
def q_binary(spark, sf):
    return files(spark, sf).where(paths.is_binary(F.col("content"))).select("path")


_HAS = lambda *segs: " OR ".join(f"strpos('/' || lower(path), '{s}') > 0" for s in segs)
_TAGS = {
    "entity:file": "true", "path:bitrix_module": _HAS("/bitrix/modules/"), "path:cache": _HAS("/cache/"), "path:core": _HAS("/bitrix/modules/", "/bitrix/admin/", "/bitrix/tools/", "/bitrix/php_interface/"),
    "path:hidden": r"regexp_matches('/' || path, '/\.[^/]')", "path:local": _HAS("/local/components/", "/local/modules/", "/local/php_interface/", "/local/templates/"), "path:local_module": _HAS("/local/modules/"),
    "path:php_interface": _HAS("/bitrix/php_interface/", "/local/php_interface/"), "path:tmp": _HAS("/tmp/"), "path:upload": _HAS("/upload/"), "path:vendor": _HAS("/vendor/"),
    "risk:executable_upload": f"({_HAS('/upload/')}) AND {EXT} IN ('php', 'php5', 'php7', 'phtml')",
}


@query("path_tags", f"{FILES} SELECT path, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {lit(t)} END' for t, c in sorted(_TAGS.items()))}], lambda x: x IS NOT NULL), ',') AS tags FROM files")
def q_path_tags(spark, sf):
    return O.site_paths(spark, sf).select("path", F.array_join(paths.path_tags(F.col("path")), ",").alias("tags"))


def sql_finding_tags(i: str = "signature_id", t: str = "rule_type") -> str:
    has = lambda *w: " OR ".join(f"strpos({i}, '{x}') > 0" for x in w)
    tags = {"engine:regex": "true", "risk:dangerous_sink": has("dangerous_call", "request_to_"), "risk:dynamic_call": has("dynamic", "callable"), "risk:encoded_payload": has("encoded", "base64", "gzinflate"), "risk:file_write": has("file_put_contents", "fwrite", "file_write"), "risk:request_input": has("request")}
    return f"array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {lit(k)} END' for k, c in sorted(tags.items()))}], lambda x: x IS NOT NULL), ',')"


@query("finding_tags", sql_all_rules() + f" SELECT path, signature_id, {sql_finding_tags()} AS tags FROM found")
def q_finding_tags(spark, sf):
    from palisade.operators.findings import finding_tags

    df = files(spark, sf).select("path", F.explode(rule_findings(F.col("path"), F.col("content"))).alias("f"))
    return df.select("path", "f.signature_id", F.array_join(finding_tags(F.col("f")), ",").alias("tags"))


@query("result_tags", sql_all_rules() + f""", t AS (SELECT path, unnest(string_split({sql_finding_tags()}, ',')) AS tag FROM found UNION SELECT path, unnest(list_filter([{', '.join(f'CASE WHEN {c} THEN {lit(t)} END' for t, c in _TAGS.items())}], lambda x: x IS NOT NULL)) FROM files)
 SELECT path AS file_path, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM t GROUP BY path""")
def q_result_tags(spark, sf):
    from palisade.operators.findings import summed, tagged

    df = fenced(files(spark, sf).withColumnRenamed("path", "file_path"), findings=tagged(rule_findings(F.col("file_path"), F.col("content")), F.col("file_path")))
    return summed(df).select("file_path", F.array_join("tags", ",").alias("tags"))


# -- hashes


@query("file_sha256", f"{FILES} SELECT path, sha256(content) AS sha256 FROM files")
def q_sha(spark, sf):
    return files(spark, sf).select("path", file_hash(F.col("content")).alias("sha256"))


_NORM = r"CASE WHEN NOT starts_with(content, chr(127) || 'ELF') THEN sha256(regexp_replace(content, '[ \t\n\x0B\f\r]+', '', 'g')) END"


@query("normalized_hash", f"{FILES} SELECT path, {_NORM} AS normalized_hash FROM files")
def q_norm(spark, sf):
    return files(spark, sf).select("path", normalized_hash(F.col("content")).alias("normalized_hash"))


@query("normalized_duplicates", f"{FILES}, n AS (SELECT {_NORM} AS normalized_hash FROM files) SELECT normalized_hash, count(*) AS n FROM n WHERE normalized_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def q_norm_dups(spark, sf):
    return fenced(files(spark, sf), normalized_hash=normalized_hash(F.col("content"))).select("normalized_hash").where("normalized_hash IS NOT NULL").groupBy("normalized_hash").agg(F.count("*").alias("n")).where("n > 1")


_EXC = lambda p: rf"trim(regexp_replace(substr(content, greatest(strpos(content, regexp_extract(content, {p})) - 1 - 60, 0) + 1, 160), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query("excerpts", f"{FILES} SELECT path, {_EXC(lit('(?i)' + RULES[0].pattern))} AS excerpt FROM files WHERE {sql_rule(RULES[0])}")
def q_excerpts(spark, sf):
    df = fenced(files(spark, sf), f=rule_finding(RULES[0], F.col("path"), F.col("content"), F.lower("content")))
    return df.where("f IS NOT NULL").select("path", F.col("f.excerpt").alias("excerpt"))


@query("fingerprints", f"{FILES}, e AS (SELECT path, {_EXC(lit('(?i)' + RULES[0].pattern))} AS excerpt FROM files WHERE {sql_rule(RULES[0])}) SELECT path, sha256(substr(lower(path), 6) || chr(10) || 'php_eval' || chr(10) || 'content' || chr(10) || sha256(substr(excerpt, 1, 512))) AS fingerprint FROM e")
def q_fingerprints(spark, sf):
    df = fenced(files(spark, sf), f=rule_finding(RULES[0], F.col("path"), F.col("content"), F.lower("content"))).where("f IS NOT NULL")
    return df.select("path", fingerprint(F.col("path"), F.col("f.signature_id"), F.col("f.target"), F.col("f.excerpt"), "/site").alias("fingerprint"))


_DB = ", db AS (SELECT DISTINCT h FROM (SELECT sha256(content) AS h FROM files WHERE doc_id % 13 = 0 UNION ALL SELECT sha256(text) FROM benchmark))"


@query("hash_db_match", f"{FILES}{_DB} SELECT path, sha256(content) AS hash, 'critical' AS severity FROM files WHERE sha256(content) IN (SELECT h FROM db)")
def q_hash_match(spark, sf):
    return hashdb.matches(files(spark, sf), hashdb.database(O.hash_items(spark, sf))).select("path", "hash", "severity")


@query("hash_prefix_gate", f"{FILES}{_DB} SELECT path FROM files WHERE sha256(content) IN (SELECT h FROM db) AND substr(sha256(content), 1, 8) IN (SELECT substr(h, 1, 8) FROM db WHERE h < '8')")
def q_gate(spark, sf):
    db = hashdb.database(O.hash_items(spark, sf))
    return hashdb.matches(files(spark, sf), db, hashdb.prefixes(db.where("hash < '8'"))).select("path")


@query("hash_prefix_build", f"{FILES}{_DB} SELECT DISTINCT substr(h, 1, 8) AS prefix FROM db")
def q_prefixes(spark, sf):
    return hashdb.prefixes(hashdb.database(O.hash_items(spark, sf)))


def feed(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    h = F.when(F.col("item_id") % 5 == 0, F.lit("bad")).otherwise(F.upper(F.sha2((F.col("item_id") % 17).cast("string"), 256)))
    sev = F.when(F.col("item_id") % 3 == 0, "medium").otherwise("low")
    return b.select(F.col("item_id").alias("ord"), h.alias("hash"), F.lit("").alias("name"), F.lit(None).cast("string").alias("family"), F.when(F.col("item_id") % 2 == 0, "webshell").otherwise("other").alias("category"), sev.alias("severity"), F.array(F.lit("A b")).alias("tags"))


@query("hash_feed_import", """WITH f AS (SELECT item_id AS ord, CASE WHEN item_id % 5 = 0 THEN 'bad' ELSE sha256((item_id % 17)::VARCHAR) END AS hash, CASE WHEN item_id % 2 = 0 THEN 'webshell' ELSE 'other' END AS category, CASE WHEN item_id % 3 = 0 THEN 'high' ELSE 'critical' END AS severity FROM benchmark),
 r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ord) AS rn FROM f WHERE hash <> 'bad')
 SELECT hash, 'PHP.Malware.' || substr(hash, 1, 12) AS name, category, severity, 'known_malware,panelica,php_malware' || CASE WHEN category = 'webshell' THEN ',webshell' ELSE '' END || ',a_b' AS tags FROM r WHERE rn = 1""")
def q_feed(spark, sf):
    items, _ = hashdb.import_feed(feed(spark, sf))
    return items.select("hash", "name", "category", "severity", F.array_join("tags", ",").alias("tags"))


@query("hash_feed_counters", """WITH f AS (SELECT CASE WHEN item_id % 5 = 0 THEN NULL ELSE item_id % 17 END AS h FROM benchmark) SELECT count(*) AS total, count(DISTINCT h) AS imported, count_if(h IS NULL)::BIGINT AS invalid, (count(h) - count(DISTINCT h)) AS duplicates FROM f""")
def q_feed_counters(spark, sf):
    return hashdb.import_feed(feed(spark, sf))[1]


# -- URLs

_URL = "(?i)https?://[^\\s''\"<>()\\[\\]{}]+"
_U = f"{FILES}, u AS (SELECT path, content, regexp_extract(content, '{_URL}') AS raw FROM files WHERE len(regexp_extract_all(content, '{_URL}')) = 1), v AS (SELECT path, content, raw, rtrim(raw, '.,;''') AS url, strpos(content, raw) - 1 AS pos FROM u), x AS (SELECT *, lower(regexp_extract(url, '(?i)^https?://([^/?#:]*)', 1)) AS domain, trim(regexp_replace(substr(content, greatest(pos - 240, 0) + 1, pos - greatest(pos - 240, 0) + length(raw) + 240), '[ \\t\\n\\r]+', ' ', 'g')) AS context FROM v)"


@query("url_extract", _U + " SELECT path, url, domain, pos::BIGINT AS at, context FROM x")
def q_urls(spark, sf):
    return fenced(files(spark, sf), u=url_info(F.col("content"))).where("u IS NOT NULL").select("path", "u.url", "u.domain", F.col("u.offset").alias("at"), "u.context")


for _n, _sig, _test in (
    ("url_iframe", "suspicious_iframe_url", "regexp_matches(context, '(?i)<iframe\\b[^>]*\\bsrc\\s*=')"),
    ("url_script", "external_script_injection", "regexp_matches(context, '(?i)<script\\b[^>]*\\bsrc\\s*=') OR (strpos(lower(context), 'document.write') > 0 AND strpos(lower(context), '<script') > 0)"),
    ("url_loader", "remote_payload_loader", "regexp_matches(context, '(?i)\\b(curl_setopt|CURLOPT_URL|file_get_contents|fopen|readfile|include|include_once|require|require_once|fsockopen|stream_socket_client)\\b')"),
):

    def _urls(sig):
        def run(spark, sf):
            df = fenced(files(spark, sf), u=url_info(F.col("content"))).where("u IS NOT NULL")
            df = df.select("path", F.col("u.url").alias("url"), F.explode(url_findings(F.col("path"), F.col("u"))).alias("f"))
            return df.where(F.col("f.signature_id") == sig).select("path", "url", "f.score")

        return run

    query(_n, _U + f" SELECT path, url, {5 if 'iframe' in _n else 6} AS score FROM x WHERE {_test}")(_urls(_sig))


@query("domain_match", _U + f""", d AS (SELECT * FROM (VALUES {', '.join(f"({i}, {lit(d)}, {lit(s)})" for i, (d, s, _) in enumerate(O.DOMAINS))}) AS t(ord, name, severity)),
 m AS (SELECT path, name, severity, row_number() OVER (PARTITION BY path ORDER BY name <> domain, ord) AS rn FROM x JOIN d ON x.domain = d.name OR ends_with(x.domain, '.' || d.name)) SELECT path, name AS matched, severity FROM m WHERE rn = 1""")
def q_domains(spark, sf):
    urls = fenced(files(spark, sf), u=url_info(F.col("content"))).where("u IS NOT NULL").select("path", F.col("u.domain").alias("domain"))
    return match_domains(urls, O.domains(spark)).select("path", F.col("match.domain").alias("matched"), F.col("match.severity").alias("severity"))


@query("line_numbers", _U + " SELECT path, (length(substr(content, 1, pos)) - length(replace(substr(content, 1, pos), chr(10), '')) + 1)::INT AS line FROM x")
def q_lines(spark, sf):
    return fenced(files(spark, sf), u=url_info(F.col("content"))).where("u IS NOT NULL").select("path", "u.line")


# -- entropy

_RUN = "SELECT path, content, regexp_extract(content, '[A-Za-z0-9+/=]{200,}') AS v FROM files WHERE len(regexp_extract_all(content, '[A-Za-z0-9+/=]{200,}')) = 1"
_BITS = "(SELECT sum(-(c::DOUBLE / length(v)) * log2(c::DOUBLE / length(v))) FROM (SELECT count(*) AS c FROM (SELECT unnest(string_split(v, '')) AS ch) GROUP BY ch))"


@query("entropy_values", f"{FILES}, e AS ({_RUN}), k AS (SELECT path, v, unnest(string_split(v, '')) AS ch FROM e), g AS (SELECT path, v, ch, count(*) AS c FROM k GROUP BY ALL) SELECT path, round(sum(-(c::DOUBLE / length(v)) * log2(c::DOUBLE / length(v))), 4) AS bits FROM g GROUP BY path, v")
def q_entropy(spark, sf):
    df = fenced(files(spark, sf), c=F.filter(candidates(F.col("content"), 200), lambda c: c["value"].rlike("^[A-Za-z0-9+/=]+$"))).where(F.size("c") > 0)
    return df.select("path", F.round(shannon(F.get("c", F.lit(0))["value"]), 4).alias("bits"))


@query("entropy_findings", f"{FILES}, e AS ({_RUN}), k AS (SELECT path, content, v, unnest(string_split(v, '')) AS ch FROM e), g AS (SELECT path, content, v, ch, count(*) AS c FROM k GROUP BY ALL), b AS (SELECT path, content, v, sum(-(c::DOUBLE / length(v)) * log2(c::DOUBLE / length(v))) AS bits FROM g GROUP BY path, content, v) SELECT path, (strpos(content, v) - 1)::BIGINT AS at, length(v)::INT AS n FROM b WHERE bits >= 4.7")
def q_entropy_findings(spark, sf):
    df = files(spark, sf).select("path", F.explode(entropy_findings(F.col("path"), F.col("content"))).alias("f"))
    return df.select("path", F.col("f.offset").alias("at"), F.col("f.length").alias("n")).distinct()


# -- server configuration

_HT = f"{FILES}, h AS (SELECT path, content FROM files WHERE ends_with(path, '/.htaccess')), l AS (SELECT path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n, trim(unnest(string_split(content, chr(10)))) AS t FROM h), k AS (SELECT * FROM l WHERE t <> '' AND NOT starts_with(t, '#'))"


@query("htaccess_lines", _HT + " SELECT path, n::INT AS n, t FROM k")
def q_ht_lines(spark, sf):
    df = files(spark, sf).where(paths.basename(F.col("path")) == ".htaccess").select("path", F.explode(lines(F.col("content"))).alias("l"))
    return df.select("path", "l.n", "l.t")


@query("htaccess_rewrite_context", _HT + """, m AS (SELECT *, regexp_matches(t, '(?i)^\\s*RewriteCond\\b') AS cond, regexp_matches(t, '(?i)^\\s*RewriteRule\\b') AS rule, strpos(lower(t), '<files') > 0 AS keep FROM k),
 s AS (SELECT *, coalesce(sum(CASE WHEN rule OR NOT (cond OR keep) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM m)
 SELECT r.path, r.n::INT AS n, coalesce((SELECT string_agg(t, ' ; ' ORDER BY n) FROM (SELECT c.t, c.n FROM s c WHERE c.path = r.path AND c.run = r.run AND c.cond AND c.n < r.n ORDER BY c.n DESC LIMIT 4)), '') AS context FROM s r WHERE r.rule""")
def q_ht_rewrites(spark, sf):
    df = files(spark, sf).where(paths.basename(F.col("path")) == ".htaccess").withColumn("rows", lines(F.col("content"))).select("path", F.explode(rewrites(F.col("rows"))).alias("r"))
    return df.select("path", "r.n", F.array_join("r.ctx", " ; ").alias("context"))


_HM = lambda p, c="t": f"regexp_matches({c}, {lit('(?i)' + p)})"
_HX = "lower(regexp_extract(rest, '(?i)\\.[a-z0-9_+-]+'))"
_HS = " OR ".join(f"strpos(lower(path), {lit(x)}) > 0" for x in htaccess.SENSITIVE)
_HF = _HT + f""", m AS (SELECT *, {_HM("^\\s*RewriteCond\\b")} AS cond, {_HM("^\\s*RewriteRule\\b")} AS rule, strpos(lower(t), '<files') > 0 AS keep FROM k),
 s AS (SELECT *, coalesce(sum(CASE WHEN rule OR NOT (cond OR keep) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM m),
 w AS (SELECT r.path, r.n, r.t, coalesce((SELECT list(t ORDER BY n) FROM (SELECT c.t, c.n FROM s c WHERE c.path = r.path AND c.run = r.run AND c.cond AND c.n < r.n ORDER BY c.n DESC LIMIT 4)), []) AS ctx FROM s r WHERE r.rule),
 x AS (SELECT *, regexp_extract(t, {lit('(?i)' + htaccess.HANDLER)}, 1) AS rest FROM k),
 y AS (SELECT *, {_HM(htaccess.HANDLER)} AND len(regexp_extract_all(rest, '(?i)\\.[a-z0-9_+-]+')) = 1 AND {_HX} IN ({', '.join(map(lit, htaccess.STATIC))}) AS handler, {_HX} AS ext FROM x),
 f AS (SELECT path, 'htaccess_php_handler_for_static_ext' AS signature_id, 'critical' AS severity, 10 AS score, n, t || ' | extension: ' || ext AS excerpt FROM y WHERE handler
  UNION ALL SELECT path, 'htaccess_php_handler_for_static_ext', 'critical', 10, n, t FROM y WHERE NOT handler AND {_HM(htaccess.SET_HANDLER)}
  UNION ALL SELECT path, 'htaccess_auto_prepend_append', 'critical', 10, n, t FROM y WHERE {_HM(htaccess.PREPEND)}
  UNION ALL SELECT path, 'htaccess_embedded_code', 'critical', 10, n, t FROM y WHERE {_HM(htaccess.EMBEDDED)}
  UNION ALL SELECT path, 'htaccess_foreign_cms_marker', CASE WHEN {_HM(htaccess.CMS_HIGH)} THEN 'high' ELSE 'medium' END, CASE WHEN {_HM(htaccess.CMS_HIGH)} THEN 6 ELSE 4 END, n, t FROM y WHERE {_HM(htaccess.CMS)}
  UNION ALL SELECT path, 'htaccess_access_bypass', 'high', 7, n, t || ' | path: ' || lower(path) FROM y WHERE ({_HS}) AND {_HM(htaccess.BYPASS)}
  UNION ALL SELECT path, 'htaccess_suspicious_rewrite', 'high', 7, n, t || CASE WHEN len(ctx) > 0 THEN ' | context: ' || array_to_string(ctx, ' ; ') ELSE '' END FROM w
   WHERE {_HM(htaccess.CONDITION, "t || chr(10) || array_to_string(ctx, chr(10))")} OR {_HM(htaccess.TARGET, "t || chr(10) || array_to_string(ctx, chr(10))")})
 SELECT path, signature_id, severity, score::INT AS score, n::BIGINT AS line, excerpt FROM f"""


@query("htaccess_findings", _HF)
def q_ht_findings(spark, sf):
    df = files(spark, sf).select("path", F.explode(htaccess_findings(F.col("path"), F.col("content"))).alias("f"))
    return df.select("path", "f.signature_id", "f.severity", "f.score", F.col("f.offset").alias("line"), "f.excerpt")


# -- baseline

_BASE = f"WITH a AS ({sql_files('old')}), b AS ({sql_files('new')}), d AS (SELECT substr(coalesce(b.path, a.path), 6) AS rel, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN a.content <> b.content THEN 'modified' END AS change, regexp_replace(a.content, '[ \\t\\n\\r]+', '', 'g') <> regexp_replace(b.content, '[ \\t\\n\\r]+', '', 'g') AS nh, starts_with(coalesce(b.content, a.content), chr(127)) AS bin FROM a FULL JOIN b ON a.path = b.path), c AS (SELECT rel, change, CASE WHEN NOT bin THEN nh END AS nh FROM d WHERE change IS NOT NULL)"
_CRIT = "(lower(rel) IN ('/bitrix/php_interface/init.php', '/local/php_interface/init.php') OR regexp_matches(rel, '(^|/)\\.htaccess$') OR regexp_matches(lower(rel), '^/(bitrix/admin|bitrix/tools|upload|local/modules|bitrix/modules)/'))"


def base_diff(spark, sf, root="/site", files=None):
    config, files = ScanConfig.of(document_root=root), files or (lambda edit: O.site_files(spark, sf, edit))
    return baseline.difference(baseline.snapshot(files("old"), config), baseline.snapshot(files("new"), config))


@query("baseline_diff", _BASE + " SELECT rel AS relative_path, change, nh AS normalized_hash_changed FROM c")
def q_base(spark, sf):
    return base_diff(spark, sf).select("relative_path", "change", "normalized_hash_changed")


@query("baseline_summary", _BASE + f" SELECT (count(*) + count_if({_CRIT}))::BIGINT AS findings_total, count_if(change = 'new')::BIGINT AS new_files, count_if(change = 'modified')::BIGINT AS modified_files, count_if(change = 'deleted')::BIGINT AS deleted_files, count_if({_CRIT})::BIGINT AS critical_changes FROM c")
def q_base_summary(spark, sf):
    return baseline.counts(baseline.results(base_diff(spark, sf)))


@query("baseline_critical", _BASE + f" SELECT rel AS relative_path FROM c WHERE {_CRIT}")
def q_base_critical(spark, sf):
    return base_diff(spark, sf).where(baseline.critical(F.col("relative_path"))).select("relative_path")


# -- whitelist and suppression

_RULES = {
    "path": ({"id": "w1", "type": "path", "path": "/site/s0/upload/doc_0.php"}, "lower(path) = '/site/s0/upload/doc_0.php'"),
    "regex": ({"id": "w2", "type": "path_regex", "pattern": "/bitrix/tools/.*\\.php$"}, "regexp_matches(lower(path), '/bitrix/tools/.*\\.php$')"),
    "signature": ({"id": "w3", "type": "signature", "signature_id": "php_eval"}, "signature_id = 'php_eval'"),
    "file_signature": ({"id": "w4", "type": "file_signature", "signature_id": "php_shell_exec", "path": "/site/s0/bitrix/tools/doc_3.php"}, "signature_id = 'php_shell_exec' AND lower(path) = '/site/s0/bitrix/tools/doc_3.php'"),
}


def rule_scan(spark, sf):
    from palisade.operators.findings import summed, tagged

    df = files(spark, sf).select(F.col("path").alias("file_path"), file_hash(F.col("content")).alias("file_hash"), "content")
    df = fenced(df, findings=rule_findings(F.col("file_path"), F.col("content"))).drop("content")
    return summed(fenced(df, findings=tagged(F.col("findings"), F.col("file_path"), "/site")))


for _k, (_rule, _cond) in _RULES.items():

    def _white(rule):
        def run(spark, sf):
            df = whitelist.whitelisted(rule_scan(spark, sf), [rule]).where(F.size("ignored") > 0)
            return df.select("file_path", F.size("ignored").alias("n_ignored"), "score", "status")

        return run

    query(f"whitelist_{_k}", sql_all_rules() + f""", g AS (SELECT path AS file_path, count_if({_cond})::INT AS n_ignored, coalesce(sum(CASE WHEN {_cond} THEN 0 ELSE score END), 0)::INT AS score FROM found GROUP BY path)
 SELECT file_path, n_ignored, score, CASE WHEN score >= 8 THEN 'malicious' WHEN score >= 4 THEN 'suspicious' WHEN score > 0 THEN 'low_risk' ELSE 'clean' END AS status FROM g WHERE n_ignored > 0""")(_white(_rule))

_HASHED = O.TEMPLATES[3][2]


@query(
    "whitelist_hash",
    sql_all_rules() + ", one AS (SELECT sha256(content) AS h FROM files WHERE doc_id = 3), marked AS (SELECT path FROM files WHERE sha256(content) = (SELECT h FROM one)) SELECT path AS file_path, count(*)::INT AS n_ignored, 0::INT AS score FROM found WHERE path IN (SELECT path FROM marked) GROUP BY path",
)
def q_white_hash(spark, sf):
    one = files(spark, sf).where("doc_id = 3").select(F.sha2("content", 256)).first()[0]
    df = whitelist.whitelisted(rule_scan(spark, sf), [{"id": "w5", "type": "hash", "hash": one}]).where(F.size("ignored") > 0)
    return df.select("file_path", F.size("ignored").alias("n_ignored"), "score")


_SUPPRESS = f"{sql_all_rules()}, g AS (SELECT path AS file_path, count_if(signature_id = 'php_eval')::INT AS n_ignored, coalesce(sum(CASE WHEN signature_id = 'php_eval' THEN 0 ELSE score END), 0)::INT AS score FROM found GROUP BY path)"


def suppress_eval(spark, sf):
    scan = rule_scan(spark, sf).persist()  # the list of marks, the join on them and the result read it: one scan
    marks = report.finding_rows(scan).where("signature_id = 'php_eval'").select("fingerprint")
    return whitelist.suppressed(scan, marks)


@query("suppression_antijoin", _SUPPRESS + " SELECT file_path, n_ignored FROM g WHERE n_ignored > 0")
def q_suppress(spark, sf):
    return suppress_eval(spark, sf).where(F.size("ignored") > 0).select("file_path", F.size("ignored").alias("n_ignored"))


@query("recalc_after_suppression", _SUPPRESS + " SELECT file_path, score FROM g WHERE n_ignored > 0")
def q_recalc(spark, sf):
    return suppress_eval(spark, sf).where(F.size("ignored") > 0).select("file_path", "score")


for _a, _dry, _want in (("report", True, ("reported", None)), ("quarantine", True, ("dry_run", "quarantine")), ("delete", False, ("pending", "delete"))):

    def _act(action, dry):
        def run(spark, sf):
            a, p = whitelist.planned_action(F.col("status"), has_risk(F.col("findings")), action, dry)
            return rule_results(spark, sf).select("file_path", a.alias("action"), p.alias("planned"))

        return run

    query(f"action_plan_{_a}", sql_all_rules() + SUMS + f" SELECT path AS file_path, CASE WHEN score > 0 THEN {lit(_want[0])} END AS action, {f'CASE WHEN score > 0 THEN {lit(_want[1])} END' if _want[1] else 'NULL::VARCHAR'} AS planned FROM sums")(_act(_a, _dry))


# -- configuration tables

_AG = f"WITH a AS ({O.sql_agents()}), f AS (SELECT id, active, unnest(list_filter([CASE WHEN module_id = '' OR module_id NOT IN ({', '.join(map(lit, O.MODULES))}) THEN {{'s': 'bitrix_agent_unknown_module', 'c': 4}} END, CASE WHEN regexp_matches(name, '(?i)\\b(base64_decode|gzinflate|gzuncompress|str_rot13|chr|pack)\\s*\\(') THEN {{'s': 'bitrix_agent_encoded_payload', 'c': 7}} END, CASE WHEN regexp_matches(name, '(?i)\\b(eval|assert|create_function|system|exec|shell_exec|passthru|proc_open)\\s*\\(') OR regexp_matches(name, '(?i)\\b(include|include_once|require|require_once)\\s*\\(?\\s*\\$') THEN {{'s': 'bitrix_agent_dangerous_php_execution', 'c': 9}} END, CASE WHEN regexp_matches(name, '(?i)\\$_(GET|POST|REQUEST|COOKIE|FILES)\\b') THEN {{'s': 'bitrix_agent_request_to_sink', 'c': 10}} END, CASE WHEN regexp_matches(name, '(?i)https?://') THEN {{'s': 'bitrix_agent_remote_loader', 'c': 6}} END, CASE WHEN regexp_matches(name, '(?i)\\b(file_put_contents|fopen|fwrite)\\s*\\(') THEN {{'s': 'bitrix_agent_file_write', 'c': 6}} END], lambda x: x IS NOT NULL)) AS x FROM a)"


@query("agent_heuristics", _AG + " SELECT id::VARCHAR AS id, x.s AS signature_id, least(x.c + CASE WHEN active = 'Y' THEN 1 ELSE 0 END, 10)::INT AS score FROM f")
def q_agents(spark, sf):
    rows = tables.with_installed(tables.strings(O.agents(spark, sf), tables.AGENT), "MODULE_ID", O.modules(spark))
    f = tables.agent_findings(F.col("NAME"), F.col("MODULE_ID"), F.col("ACTIVE"), F.col("installed"))
    return rows.select(F.col("ID").alias("id"), F.explode(f).alias("f")).select("id", "f.signature_id", "f.score")


@query("agent_results")
def q_agent_results(spark, sf):
    df = tables.judged_agents(O.agents(spark, sf), O.modules(spark))
    return df.select("ID", "score", "severity", "status", F.array_join("signatures", ",").alias("signatures"))


_CE = ", ".join(map(lit, tables.CRITICAL_EVENTS))
_EV = f"WITH h AS ({O.sql_handlers()}), f AS (SELECT id, unnest(list_filter([CASE WHEN to_module_id = '' THEN {{'s': 'bitrix_event_empty_module', 'c': 4}} WHEN NOT regexp_matches(to_module_id, '^[a-zA-Z0-9_.-]+$') OR to_module_id NOT IN ({', '.join(map(lit, O.MODULES))}) THEN {{'s': 'bitrix_event_critical_hook_unknown_module', 'c': CASE WHEN lower(message_id) IN ({_CE}) THEN 7 ELSE 4 END}} END, CASE WHEN regexp_matches(to_method, '(?i)\\b(eval|assert|system|exec|shell_exec|passthru|proc_open)\\b') THEN {{'s': 'bitrix_event_dangerous_method_name', 'c': 7}} END, CASE WHEN regexp_matches(to_class || '::' || to_method, '[$\\[\\]{{}}]|call_user_func|create_function') THEN {{'s': 'bitrix_event_dynamic_callable', 'c': 6}} END, CASE WHEN regexp_matches(to_method, '(?i)\\$_(GET|POST)\\b') THEN {{'s': 'bitrix_event_request_to_sink', 'c': 10}} END], lambda x: x IS NOT NULL)) AS x FROM h)"


@query("event_risks", _EV + " SELECT id::VARCHAR AS id, x.s AS signature_id, x.c::INT AS score FROM f")
def q_events(spark, sf):
    rows = tables.with_installed(tables.strings(O.handlers(spark, sf), tables.HANDLER), "TO_MODULE_ID", O.modules(spark))
    return rows.select(F.col("ID").alias("id"), F.explode(tables.event_findings()).alias("f")).select("id", "f.signature_id", "f.score")


def handler_code(spark):
    rows = [("/site/local/php_interface/init.php", "<?php function OnAfter() {} class CMain { function OnAfter($x) { eval($_POST['a']); } }"), ("/site/bitrix/modules/click/lib/handler.php", "<?php namespace A; class Handler { public static function run() { echo 1; } }"), ("/site/bitrix/modules/view/include.php", "<?php class Handler { function run() { system($_GET['c']); } }")]
    return spark.createDataFrame(rows, "path string, content string")


@query("handler_resolution", f"""WITH h AS ({O.sql_handlers()}) SELECT id::VARCHAR AS id, '/site/local/php_interface/init.php' AS path FROM h WHERE to_class = 'CMain' AND to_method = 'OnAfter'
 UNION ALL SELECT id::VARCHAR, '/site/bitrix/modules/click/lib/handler.php' FROM h WHERE to_method = 'run' AND to_module_id = 'click' UNION ALL SELECT id::VARCHAR, '/site/bitrix/modules/view/include.php' FROM h WHERE to_method = 'run' AND to_module_id = 'view'""")
def q_resolution(spark, sf):
    return tables.resolved(tables.strings(O.handlers(spark, sf), tables.HANDLER), handler_code(spark), "/site").select(F.col("ID").alias("id"), "path")


_BAD = "to_class = 'CMain' AND to_method = 'OnAfter' OR to_class <> '' AND to_method = 'run' AND to_module_id = 'view'"
_HR = _EV.replace("f AS (SELECT id,", "f0 AS (SELECT id,") + f""", f AS (SELECT id, x.s AS s, x.c AS c, 0 AS late FROM f0 UNION ALL SELECT id, unnest(['bitrix_event_handler_file_suspicious', 'bitrix_event_request_to_sink']), 10, unnest([1, 2]) FROM h WHERE {_BAD}),
 o AS (SELECT *, late * 10 + CASE s WHEN 'bitrix_event_empty_module' THEN 0 WHEN 'bitrix_event_critical_hook_unknown_module' THEN 1 WHEN 'bitrix_event_dangerous_method_name' THEN 2 WHEN 'bitrix_event_dynamic_callable' THEN 3 ELSE 4 END AS place,
  CASE WHEN late > 0 OR s = 'bitrix_event_request_to_sink' THEN 4 WHEN s = 'bitrix_event_empty_module' OR s = 'bitrix_event_critical_hook_unknown_module' AND c = 4 THEN 2 ELSE 3 END AS w FROM f),
 g AS (SELECT id, sum(c)::INT AS total, max(w) AS w, string_agg(s, ',' ORDER BY place) AS signatures FROM o GROUP BY id)
 SELECT id::VARCHAR AS "ID", total AS score, (['info', 'low', 'medium', 'high', 'critical'])[w + 1] AS severity, CASE WHEN total >= 8 THEN 'malicious' WHEN total >= 4 THEN 'suspicious' WHEN total > 0 THEN 'low_risk' ELSE 'clean' END AS status, signatures FROM g"""


@query("handler_results", _HR)
def q_handler_results(spark, sf):
    df = tables.scan_handlers(O.handlers(spark, sf), O.modules(spark), handler_code(spark), ScanConfig.of(document_root="/site"))
    return df.select("ID", "score", "severity", "status", F.array_join(F.transform("findings", lambda f: f["signature_id"]), ",").alias("signatures"))


# -- reports


@query("scan_summary", sql_all_rules() + SUMS + " SELECT count(*) AS processed_total, count_if(score > 0)::BIGINT AS found_total, (SELECT count(*) FROM found) AS findings_total FROM sums")
def q_summary(spark, sf):
    return report.summary(rule_results(spark, sf)).select("processed_total", "found_total", "findings_total")


@query("report_rows", sql_all_rules() + " SELECT path AS file_path, signature_id, score FROM found")
def q_rows(spark, sf):
    return report.finding_rows(rule_results(spark, sf)).select("file_path", "signature_id", "score")


@query("report_by_tag", sql_all_rules() + " SELECT path AS file_path, signature_id FROM found WHERE strpos(signature_id, 'encoded') > 0 OR strpos(signature_id, 'base64') > 0 OR strpos(signature_id, 'gzinflate') > 0")
def q_by_tag(spark, sf):
    return report.by_tag(report.finding_rows(rule_scan(spark, sf)), " Risk:Encoded_Payload ").select("file_path", "signature_id")


@query("report_topk_score", sql_all_rules() + SUMS + " SELECT path AS file_path, score FROM sums ORDER BY score DESC, path LIMIT 20")
def q_topk(spark, sf):
    return rule_results(spark, sf).select("file_path", "score").orderBy(F.desc("score"), "file_path").limit(20)


@query("report_sort_signature", sql_all_rules() + " SELECT path AS file_path, signature_id, score FROM found")
def q_sort(spark, sf):
    return report.ordered(report.finding_rows(rule_results(spark, sf)), "signature_id", False).select("file_path", "signature_id", "score")


@query("report_tags", sql_all_rules() + f" SELECT DISTINCT tag FROM (SELECT unnest(string_split({sql_finding_tags()}, ',')) AS tag FROM found UNION ALL SELECT unnest(list_filter([{', '.join(f'CASE WHEN {c} THEN {lit(t)} END' for t, c in _TAGS.items())}], lambda x: x IS NOT NULL)) FROM files)")
def q_report_tags(spark, sf):
    return report.report_tags(rule_scan(spark, sf))


# -- prefix bitmaps

for _len in (8, 12):
    _pre = f"p AS (SELECT DISTINCT substr(h, 1, {_len}) AS prefix FROM db WHERE h < '8')"

    def _gate(length, counts):
        def run(spark, sf):
            db = hashdb.database(O.hash_items(spark, sf))
            index = hashdb.prefix_filter(hashdb.prefixes(db.where("hash < '8'"), length), length)
            rows = fenced(files(spark, sf), hash=file_hash(F.col("content"))).select("path", "hash")
            return hashdb.gate_counts(rows, index) if counts else hashdb.gated(rows, index).select("path", "hash")

        return run

    query(f"hash_prefix_bitmap_{_len}", f"{FILES}{_DB}, {_pre} SELECT path, sha256(content) AS hash FROM files WHERE substr(sha256(content), 1, {_len}) IN (SELECT prefix FROM p)")(_gate(_len, False))
    query(f"hash_prefix_skipped_{_len}", f"""{FILES}{_DB}, {_pre}, n AS (SELECT ((count(*) * 16 + 32767) // 32768 * 32768)::BIGINT AS bits FROM p), b AS (SELECT DISTINCT ('0x' || prefix)::BIGINT % bits AS place FROM p, n)
 SELECT count(*) AS hashes, count_if(('0x' || substr(sha256(content), 1, {_len}))::BIGINT % bits NOT IN (SELECT place FROM b))::BIGINT AS skipped FROM files, n""")(_gate(_len, True))


# -- files made of pages

_PAGES = "WITH files AS (SELECT page_id AS doc_id, '/site/p_' || page_id || '.html' AS path, coalesce(html, '') AS content FROM pages)"
_LINKS = "WITH files AS (SELECT page_id AS doc_id, '/site/l_' || page_id || '.html' AS path, " + O.sql_link("coalesce(url, '')") + " AS content FROM pages)"




@query("page_normalized_hash", f"{_PAGES} SELECT path, sha256(content) AS sha256, {_NORM} AS normalized_hash FROM files")
def q_page_hashes(spark, sf):
    return O.page_files(spark, sf).select("path", file_hash(F.col("content")).alias("sha256"), normalized_hash(F.col("content")).alias("normalized_hash"))


@query("link_rule_findings", sql_all_rules().replace(FILES, _LINKS) + " SELECT path, signature_id, severity, score FROM found")
def q_link_rules(spark, sf):
    df = O.link_files(spark, sf).select("path", F.explode(rule_findings(F.col("path"), F.col("content"))).alias("f"))
    return df.select("path", "f.signature_id", "f.severity", "f.score")


@query("link_urls", _U.replace(FILES, _LINKS) + " SELECT path, url, domain, pos::BIGINT AS at, context FROM x")
def q_link_urls(spark, sf):
    return fenced(O.link_files(spark, sf), u=url_info(F.col("content"))).where("u IS NOT NULL").select("path", "u.url", "u.domain", F.col("u.offset").alias("at"), "u.context")


_LIST = " UNION ALL ".join(f"SELECT {i} AS ord, {lit(d)} AS known, {lit(sev)} AS severity" for i, (d, sev, _) in enumerate(O.DOMAINS))


@query("link_domains", _U.replace(FILES, _LINKS) + f", k AS ({_LIST}), m AS (SELECT path, domain, known, severity, row_number() OVER (PARTITION BY path ORDER BY domain <> known, ord) AS r FROM x JOIN k ON domain = known OR ends_with(domain, '.' || known)) SELECT path, domain, known AS matched_domain, severity FROM m WHERE r = 1")
def q_link_domains(spark, sf):
    seen = O.link_files(spark, sf).select("path", url_info(F.col("content")).alias("u")).where("u IS NOT NULL").select("path", F.col("u.domain").alias("domain"))
    return seen.join(match_domains(seen, O.domains(spark)), "path").select("path", "domain", F.col("match.domain").alias("matched_domain"), "match.severity")


# -- baseline of a site whose files lie at its root

def root_diff(spark, sf):
    return base_diff(spark, sf, files=lambda edit: O.at_root(files(spark, sf, edit)))


_AT = O.sql_at_root
_ROOT = f"WITH a AS ({_AT(sql_files('old'))}), b AS ({_AT(sql_files('new'))}), d AS (SELECT substr(coalesce(b.path, a.path), 6) AS rel, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN a.content <> b.content THEN 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path), c AS (SELECT * FROM d WHERE change IS NOT NULL)"
_LOWER = f"lower(rel)"
_T44 = f"""{_ROOT} SELECT rel AS relative_path, 'baseline_' || change || '_file' AS signature_id, 'medium' AS severity, CASE WHEN change = 'modified' THEN 4 ELSE 3 END::INT AS score FROM c
 UNION ALL SELECT rel, 'baseline_critical_path_changed', 'high', 5::INT FROM c WHERE {_CRIT}
 UNION ALL SELECT rel, 'baseline_php_in_upload', 'critical', 9::INT FROM c WHERE change = 'new' AND starts_with(lower(rel), '/upload/') AND regexp_matches(lower(rel), '\\.(php|php3|php4|php5|php7|php8|phtml|pht)$')
 UNION ALL SELECT rel, 'baseline_unknown_file_in_tools', 'high', 7::INT FROM c WHERE change = 'new' AND (starts_with(lower(rel), '/bitrix/tools/') OR starts_with(lower(rel), '/bitrix/admin/'))"""


@query("baseline_root_findings", _T44)
def q_root_findings(spark, sf):
    rows = baseline.results(root_diff(spark, sf)).select("relative_path", F.explode("findings").alias("f"))
    return rows.select("relative_path", "f.signature_id", "f.severity", "f.score")


@query("baseline_projection", f"WITH t AS ({_T44}) SELECT '/site' || relative_path AS \"FILE\", signature_id AS \"SIGNATURE\", severity AS \"SEVERITY\", score AS \"SCORE\", relative_path AS \"EXCERPT\", substr(md5('/site' || relative_path), 1, 16) AS id_start FROM t")
def q_base_rows(spark, sf):
    rows = report.baseline_projection(baseline.results(root_diff(spark, sf)))
    return rows.select("FILE", "SIGNATURE", "SEVERITY", "SCORE", "EXCERPT", F.substring("ID", 1, 16).alias("id_start"))


# -- the projection of a report's rows, and its pages

_SEVERITY = f"CASE x.s WHEN 'bitrix_event_empty_module' THEN 'medium' WHEN 'bitrix_event_critical_hook_unknown_module' THEN CASE WHEN x.c = 7 THEN 'high' ELSE 'medium' END WHEN 'bitrix_event_request_to_sink' THEN 'critical' ELSE 'high' END"
_VERDICT = "CASE WHEN total >= 8 THEN 'malicious' WHEN total >= 4 THEN 'suspicious' WHEN total > 0 THEN 'low_risk' ELSE 'clean' END"
_REASON = """CASE x.s WHEN 'bitrix_event_empty_module' THEN 'empty_to_module_id' WHEN 'bitrix_event_critical_hook_unknown_module' THEN CASE WHEN regexp_matches(to_module_id, '^[a-zA-Z0-9_.-]+$') THEN 'module_not_installed' ELSE 'invalid_to_module_id' END
 WHEN 'bitrix_event_dangerous_method_name' THEN lower(regexp_extract(to_method, '(?i)\\b(eval|assert|system|exec|shell_exec|passthru|proc_open)\\b', 1)) || CASE WHEN to_class = '' THEN '_without_class' ELSE '' END WHEN 'bitrix_event_dynamic_callable' THEN 'dynamic_callable' ELSE 'request_to_sink' END"""
_EVP = _EV.replace("f AS (SELECT id,", "f AS (SELECT id, message_id, to_module_id, to_class, to_method,") + f""", g AS (SELECT *, x.s AS signature_id, {_SEVERITY} AS severity, {_REASON} AS reason, sum(x.c) OVER (PARTITION BY id)::INT AS total, 'bitrix-db://b_module_to_module/' || id AS path,
 concat_ws(' ', 'main', message_id, nullif(to_module_id, ''), nullif(to_class, ''), nullif(to_method, '')) AS excerpt FROM f)"""


@query("report_projection", _EVP + f""" SELECT 'finding_' || substr(md5(path), 1, 16) AS id_start, 'scan-1' AS scan_id, path AS file_path, '' AS file_hash, '' AS normalized_hash, sha256(lower(replace(path, '//', '/')) || chr(10) || signature_id || chr(10) || 'db_event' || chr(10) || sha256(substr(excerpt, 1, 512))) AS finding_fingerprint,
 {_VERDICT} AS status, total AS score, severity, signature_id, 'bitrix_db' AS category, '' AS confidence, '' AS url, '' AS domain, '' AS hash, '' AS recommendation, excerpt, NULL::DOUBLE AS entropy, NULL::INT AS length, 'bitrix_event_handler' AS entity_type, id::VARCHAR AS db_id, to_module_id AS db_module_id, 'main' AS db_from_module_id,
 message_id AS db_message_id, to_class AS db_to_class, to_method AS db_to_method, '100' AS db_sort, '' AS db_active, '' AS db_next_exec, reason AS risk_reason, '' AS resolved_file, path AS of_result, signature_id AS of_finding, 'b_module_to_module' AS of_trace FROM g""")
def q_projection(spark, sf):
    res = tables.scan_handlers(O.handlers(spark, sf), O.modules(spark)).withColumn("normalized_hash", F.lit(None).cast("string"))
    rows = report.projection(res, "scan-1")
    said = {"of_result": ("scan_result", "$.file_path"), "of_finding": ("finding", "$.signature_id"), "of_trace": ("db_trace", "$.table")}
    return rows.withColumns({k: F.try_variant_get(c, p, "string") for k, (c, p) in said.items()}).withColumn("id_start", F.substring("id", 1, 24)).drop("id", "db_trace", "scan_result", "finding", "tags")


@query("report_page", sql_all_rules() + " SELECT path AS file_path, signature_id, score FROM found ORDER BY signature_id, path LIMIT 50 OFFSET 150")
def q_page(spark, sf):
    rows = report.finding_rows(rule_results(spark, sf)).select("file_path", "signature_id", "score", "pos")
    return report.page(report.ordered(rows, "signature_id", False), 4, 50).select("file_path", "signature_id", "score")


# -- whole scans and code, beyond SQL


@query("full_scan")
def q_full(spark, sf):
    known = hashdb.Known(hashdb.database(O.hash_items(spark, sf)))
    df = scanned(files(spark, sf), CONFIG, known=known, domains=O.domains(spark), code=True)
    return df.select("file_path", "file_hash", "normalized_hash", "score", "severity", "status", F.array_join("tags", ",").alias("tags"), F.array_join(F.transform("findings", lambda f: f["signature_id"]), ",").alias("signatures"))


def _code(prefix):
    def run(spark, sf):
        from palisade.operators.code import with_code_findings

        df = with_code_findings(files(spark, sf).select("path", "content")).select("path", F.explode("code_findings").alias("f"))
        return df.where(F.col("f.signature_id").startswith(prefix)).select("path", "f.signature_id", "f.severity", "f.score", "f.line", "f.excerpt")

    return run


query("ast_findings")(_code("php_ast_"))
query("taint_findings")(_code("taint_"))


@query("stream_equals_batch")
def q_stream(spark, sf):
    from palisade.streaming.scan import scan_stream_once

    return scan_stream_once(spark, files(spark, sf).select("path", "content"), CONFIG).select("file_path", "score", "status")


def entry(spark: SparkSession) -> DataFrame:
    return q_full(spark, "/root/testdata/sf0.001")
