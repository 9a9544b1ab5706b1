"""Analyzers of two configuration tables: scheduled agents and event handlers."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import ScanConfig
from palisade.functions.hashes import collapsed, fingerprint
from palisade.functions.paths import lowered
from palisade.operators.findings import deduped, fenced, finding_tags, has_risk, result_tags, scanned, summed, tagged, with_fields
from palisade.operators.rules import at_known_place, java_pattern, named_by_number
from palisade.schema import FINDINGS, finding, no_findings, severity_of, some, weight

# Fixed values.
ENCODED = r"\b(base64_decode|gzinflate|gzuncompress|str_rot13|chr|pack)\s*\("
DANGEROUS = r"\b(eval|assert|create_function|system|exec|shell_exec|passthru|proc_open)\s*\("
DYNAMIC_INCLUDE = r"\b(include|include_once|require|require_once)\s*\(?\s*\$"
REQUEST = r"\$_(?:GET|POST|REQUEST|COOKIE|FILES)\b"
SINK_WORD = r"\b(eval|assert|system|exec|shell_exec|passthru|proc_open|popen|include|include_once|require|require_once|call_user_func|call_user_func_array)\b"
REMOTE = r"https?://[^\s'\")<>]+"
FILE_WRITE = r"\b(file_put_contents|fopen|fwrite)\s*\("
METHOD = r"\b(eval|assert|system|exec|shell_exec|passthru|proc_open)\b"
CRITICAL_EVENTS = "OnPageStart OnBeforeProlog OnProlog OnEpilog OnBeforeUserLogin OnAfterUserLogin OnBeforeUserRegister OnAfterUserRegister OnBeforeIBlockElementAdd OnBeforeIBlockElementUpdate OnSaleOrderSaved OnBeforeEventSend OnBeforeMailSend".lower().split()
AGENT = ("ID", "MODULE_ID", "NAME", "ACTIVE", "NEXT_EXEC", "LAST_EXEC")
HANDLER = ("ID", "FROM_MODULE_ID", "MESSAGE_ID", "TO_MODULE_ID", "TO_CLASS", "TO_METHOD", "SORT")
#: A name that code can define, in bytes as Latin-1 characters.
IDENT = "[a-zA-Z_\\x80-\\xff][a-zA-Z0-9_\\x80-\\xff]*"
#: The scope of start-up files, which every handler may be defined in; the others are modules.
START_UP = ""
AGENT_TAGS = ("entity:db_agent", "engine:bitrix_db", "risk:persistence")
#: What the findings of an agent depend on, but for what :func:`of_agent` fills in.
KIND = ("NAME", "MODULE_ID", "on", "place")
#: Kinds of agents, and bytes of their names, that are sent to every task; more are met by a shuffle.
KINDS, KIND_BYTES = 4096, 4 << 20
#: Kinds that one task analyzes, where there are few and where there are many.
TASK_KINDS = (256, 20_000)


def like(c: Column, pattern: str) -> Column:
    return c.rlike(java_pattern(pattern))


def word(c: Column, pattern: str, group: int = 1) -> Column:
    return F.lower(F.regexp_extract(c, java_pattern(pattern), group))


def strings(df: DataFrame, columns) -> DataFrame:
    """All columns as text, missing ones and nulls empty."""
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns])


def with_installed(df: DataFrame, column: str, modules: DataFrame | None) -> DataFrame:
    """``installed`` true, false, or null where no list of modules is known."""
    if modules is None:
        return df.withColumn("installed", F.lit(None).cast("boolean"))
    known = modules.select(F.trim("module_id").alias("__m")).distinct().withColumn("__yes", F.lit(True))
    return df.join(known, F.trim(df[column]) == known["__m"], "left").withColumn("installed", F.coalesce("__yes", F.lit(False))).drop("__m", "__yes")


def short(text: Column) -> Column:
    t = collapsed(text)
    return F.when(F.length(t) <= 220, t).otherwise(F.concat(F.substr(t, F.lit(1), F.lit(180)), F.lit("...")))


def virtual_path(table: str, id_: Column) -> Column:
    safe = F.regexp_replace(id_, f"[^{string.digits}{string.ascii_letters}_.-]", "_")
    return F.concat(F.lit(f"bitrix-db://{table}/"), F.when(safe == "", "unknown").otherwise(safe))


def agent_trace() -> list[Column]:
    """What the trace of an agent's finding says of the agent."""
    return [F.lit("bitrix_agent").alias("entity"), F.lit("b_agent").alias("table"), *[F.col(c).alias(c.lower()) for c in AGENT if c != "NAME"]]


def agent_findings(name: Column, module: Column, active: Column, installed: Column, facts: list[Column] | None = None) -> Column:
    """Findings of an agent's row. ``facts`` open their traces, those of the agent unless others are given."""
    facts = agent_trace() if facts is None else facts
    bonus = F.when(F.upper(active) == "Y", 1).otherwise(0)
    excerpt = short(name)

    def made(sig, severity, score, tags=(), **more):
        all_tags = F.array(*map(F.lit, [*AGENT_TAGS, *tags]))
        extra = F.to_json(F.struct(*facts, *[v.alias(k) for k, v in more.items()]))
        return finding(sig, category="bitrix_db", severity=severity, score=F.least(F.lit(score) + bonus, F.lit(10)), excerpt=excerpt, target="db_agent", rule_type="bitrix_db", type="bitrix_agent", source="b_agent.NAME", trace=extra, tags=all_tags)

    danger = F.when(like(name, DANGEROUS), word(name, DANGEROUS)).when(like(name, DYNAMIC_INCLUDE), F.lit("dynamic_include"))
    unknown = F.when(F.trim(module) == "", "empty_module_id").when(~installed, "module_not_installed")
    return some(
        F.when(F.length(name) > 500, made("bitrix_agent_suspicious_long_code", "medium", 3, name_length=F.length(name))),
        F.when(unknown.isNotNull(), made("bitrix_agent_unknown_module", "medium", 4, reason=unknown)),
        F.when(like(name, ENCODED), made("bitrix_agent_encoded_payload", "high", 7, ["risk:encoded_payload"], marker=word(name, ENCODED))),
        F.when(danger.isNotNull(), made("bitrix_agent_dangerous_php_execution", "critical", 9, ["risk:dangerous_sink"], reason=danger)),
        F.when(like(name, REQUEST) & like(name, SINK_WORD), made("bitrix_agent_request_to_sink", "critical", 10, ["risk:request_input", "risk:dangerous_sink"], sink=word(name, SINK_WORD))),
        F.when(like(name, REMOTE), made("bitrix_agent_remote_loader", "high", 6, ["risk:remote_loader", "risk:external_url"], url=F.regexp_extract(name, java_pattern(REMOTE), 0))),
        F.when(like(name, FILE_WRITE), made("bitrix_agent_file_write", "high", 6, ["risk:file_write"], sink=word(name, FILE_WRITE))),
    )


def judged_agents(agents: DataFrame, modules: DataFrame | None = None, config: ScanConfig = ScanConfig(), code: bool = True) -> DataFrame:
    """Agents with findings: their columns, file_path, hashes, findings as their kind has them, the findings' ``signatures``, score, severity and status.

    Names repeat from agent to agent, so a name's code is analyzed once for all agents of a kind (:data:`KIND`), and the agents meet
    the result by their kind: in their own tasks if the kinds are few, else after a shuffle. Agents without a name have no result."""
    rows = strings(agents, AGENT).where(F.trim("NAME") != "").withColumn("on", F.col("ACTIVE").isin("Y", "y"))
    path = virtual_path("b_agent", F.col("ID"))  # as an expression, which a number for an id leaves out
    usual, numbered = "bitrix-db://b_agent/0", F.lit(not named_by_number(".php")) & F.col("ID").rlike("^[0-9]+$")
    place = F.when(numbered, usual).when(at_known_place(F.concat(path, F.lit(".php"))), path).otherwise(usual)
    rows = rows.withColumns({"file_path": path, "place": place})
    kinds = rows.select(*KIND).distinct()
    few, size = [], 0
    for r in kinds.toLocalIterator():
        few.append(r)
        size += len(r["NAME"].encode())
        if len(few) > KINDS or size > KIND_BYTES:
            break
    small = len(few) <= KINDS and size <= KIND_BYTES
    n = len(few) if small else kinds.count()
    tasks = min(-(-n // TASK_KINDS[0]), max(4 * agents.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_KINDS[1])))
    kinds = agents.sparkSession.createDataFrame(few, kinds.schema) if small else kinds
    kinds = analyzed_kinds(with_installed(kinds, "MODULE_ID", modules).repartition(max(1, tasks), *KIND), config, code)
    return rows.join(F.broadcast(kinds) if small else kinds, list(KIND)).drop("on", "place")


def analyzed_kinds(kinds: DataFrame, config: ScanConfig, code: bool) -> DataFrame:
    """Results of kinds of agents with findings: those of the analyzers on the code, then the heuristics on the row. Traces hold what the kind alone says."""
    as_file = {"path": F.concat("place", F.lit(".php")), "content": F.concat(F.lit("<?php\n"), F.rtrim("NAME"), F.lit(";\n"))}
    own = agent_findings(F.col("NAME"), F.col("MODULE_ID"), F.when(F.col("on"), "Y").otherwise("N"), F.col("installed"), [])
    df = scanned(fenced(kinds, **as_file, own=own.cast(FINDINGS)), config, code=code, paths=False, keep=(*KIND, "own"))
    no_tags = F.array().cast("array<string>")
    decorated = F.transform("findings", lambda f: with_fields(f, target=F.lit("db_agent"), source=F.lit("b_agent.NAME"), tags=F.array_union(F.coalesce(f["tags"], no_tags), F.array(*map(F.lit, AGENT_TAGS))), trace=F.to_json(F.struct(f["target"].alias("detector_target"), f["trace"].alias("detector_trace")))))
    df = fenced(df.select(*KIND, "file_path", "file_hash", "normalized_hash", "own", decorated.cast(FINDINGS).alias("findings")), findings=deduped(F.concat("findings", "own"), agent_key)).where(F.size("findings") > 0)
    df = summed(fenced(df, findings=F.transform("findings", lambda f: with_fields(f, tags=finding_tags(f)))), config)
    return df.select(*KIND, "file_hash", "normalized_hash", "findings", F.transform("findings", lambda f: f["signature_id"]).alias("signatures"), "score", "severity", "status")


def of_agent(f: Column, opening: Column, path: Column, config: ScanConfig) -> Column:
    """A kind's finding as one agent's: the trace opens with what is said of the agent, file and fingerprint are those of its path."""
    trace = F.concat(opening, F.when(f["trace"] == "{}", "}").otherwise(F.concat(F.lit(","), F.substring(f["trace"], 2, 1 << 30))))
    file = F.when(f["file"].isNotNull(), F.concat(path, F.lit(".php")))
    return with_fields(f, trace=trace, file=file, fingerprint=fingerprint(path, f["signature_id"], f["target"], f["excerpt"], config.document_root))


def scan_agents(agents: DataFrame, modules: DataFrame | None = None, config: ScanConfig = ScanConfig(), code: bool = True) -> DataFrame:
    """Results of agents with findings, as of files: :func:`judged_agents` with each agent's own findings."""
    facts = F.to_json(F.struct(*agent_trace()))
    df = fenced(judged_agents(agents, modules, config, code), opening=F.substring(facts, F.lit(1), F.length(facts) - 1))
    df = fenced(df, findings=F.transform("findings", lambda f: of_agent(f, F.col("opening"), F.col("file_path"), config)))
    tags = result_tags(F.col("file_path"), F.col("findings")).alias("tags")
    return df.select("ID", "file_path", "file_hash", "normalized_hash", "findings", "score", "severity", "status", tags)


def handler_excerpt() -> Column:
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("FROM_MODULE_ID", "MESSAGE_ID", "TO_MODULE_ID", "TO_CLASS", "TO_METHOD")])


def handler_finding(sig: str, severity, score, tags=(), **trace) -> Column:
    entity = [F.lit("bitrix_event_handler").alias("entity"), F.lit("b_module_to_module").alias("table"), *[F.col(c).alias(c.lower()) for c in HANDLER]]
    extra = F.to_json(F.struct(*entity, *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in trace.items()]))
    return finding(sig, category="bitrix_db", severity=severity, score=score, excerpt=handler_excerpt(), target="db_event", rule_type="bitrix_db", type="bitrix_event_handler", source="b_module_to_module", trace=extra, tags=F.array(*map(F.lit, ["entity:db_event", "engine:bitrix_db", "risk:persistence", *tags])))


def event_findings() -> Column:
    """Risks of a handler row, from its columns and ``installed``."""
    module, cls, method = F.trim("TO_MODULE_ID"), F.trim("TO_CLASS"), F.trim("TO_METHOD")
    critical = F.lower(F.trim("MESSAGE_ID")).isin(*CRITICAL_EVENTS)
    unknown = F.when(module == "", F.lit(None)).when(~module.rlike("^[a-zA-Z0-9_.-]+$"), "invalid_to_module_id").when(~F.col("installed"), "module_not_installed")
    reason = F.concat(word(method, METHOD), F.when(cls == "", "_without_class").otherwise(""))
    callable_ = F.lower(F.concat(cls, F.lit("::"), method))
    dynamic = callable_.rlike("[$\\[\\]{}]") | callable_.contains("call_user_func") | callable_.contains("create_function") | method.contains("->") | method.contains("::")
    return some(
        F.when(module == "", handler_finding("bitrix_event_empty_module", "medium", 4, risk_reason="empty_to_module_id")),
        F.when(unknown.isNotNull(), handler_finding("bitrix_event_critical_hook_unknown_module", F.when(critical, "high").otherwise("medium"), F.when(critical, 7).otherwise(4), risk_reason=unknown, critical_event=critical)),
        F.when(like(method, METHOD), handler_finding("bitrix_event_dangerous_method_name", "high", 7, ["risk:dangerous_sink"], risk_reason=reason)),
        F.when(dynamic, handler_finding("bitrix_event_dynamic_callable", "high", 6, ["risk:dynamic_call"], risk_reason="dynamic_callable")),
        F.when(like(method, REQUEST) & like(method, SINK_WORD), handler_finding("bitrix_event_request_to_sink", "critical", 10, ["risk:request_input", "risk:dangerous_sink"], risk_reason="request_to_sink", sink=word(method, SINK_WORD))),
    )


def definitions(files: DataFrame, document_root: str = "") -> DataFrame:
    """(path, scope, functions, classes): the names that candidate files define, in lower case. Patterns run over a file once, whatever the
    number of handlers. Scopes are modules by folder, and :data:`START_UP`."""
    root = document_root.rstrip("/").lower()
    p = lowered(F.col("path"))
    inits = [f"{root}/{x}/php_interface/init.php" for x in ("local", "bitrix")]
    module = F.regexp_extract(p, f"^{java_quoted(root)}/(?:local|bitrix)/modules/([^/]+)/(?:include\\.php|lib/.*\\.php)$", 1)
    scope = F.when(p.isin(*inits), START_UP).otherwise(F.nullif(module, F.lit("")))
    bound = "(?<![A-Za-z0-9_])"
    functions = F.regexp_extract_all("content", F.lit(f"(?i){bound}function\\s+({IDENT})\\s*\\("), F.lit(1))
    classes = F.regexp_extract_all("content", F.lit(f"(?i){bound}(?:class|trait)\\s+({IDENT})(?![A-Za-z0-9_])"), F.lit(1))
    names = lambda c: F.array_distinct(F.transform(c, F.lower))
    return files.select("path", scope.alias("scope"), "content").where("scope IS NOT NULL").select("path", "scope", names(functions).alias("functions"), names(classes).alias("classes"))


def java_quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


def resolved(handlers: DataFrame, files: DataFrame, document_root: str = "") -> DataFrame:
    """(ID, path): files that define a handler's method, and its class if it names one.

    Handlers meet the definitions on (scope, method), and those that name a class meet the file's classes on (path, class): equi-joins
    on names, so start-up files are spread by their methods, and no pattern is tried for a pair."""
    defined = definitions(files, document_root)
    methods = defined.select("path", "scope", F.explode("functions").alias("method"))
    classes = defined.select("path", F.explode("classes").alias("class")).distinct()
    safe = F.trim("TO_MODULE_ID").rlike("^[a-zA-Z0-9_.-]+$")
    scopes = F.array_compact(F.array(F.lit(START_UP), F.when(safe, F.lower(F.trim("TO_MODULE_ID")))))
    short = F.lower(F.regexp_extract(F.trim("TO_CLASS"), "([^\\\\]*)\\\\*$", 1))
    wanted = handlers.select("ID", F.explode(scopes).alias("scope"), F.lower(F.trim("TO_METHOD")).alias("method"), short.alias("class"), (F.trim("TO_CLASS") == "").alias("bare")).where("method <> ''")
    met = wanted.join(methods, ["scope", "method"])
    hit = met.where("bare").select("ID", "path").unionByName(met.where("NOT bare").join(classes, ["path", "class"]).select("ID", "path"))
    return hit.groupBy("ID", F.lower("path").alias("__p")).agg(F.min("path").alias("path")).select("ID", "path")


def agent_key(f: Column) -> Column:
    """Agents merge findings of one id, target, type, place and excerpt."""
    return F.concat_ws(":", *[F.coalesce(f[c].cast("string"), F.lit("")) for c in ("signature_id", "target", "rule_type", "offset")], F.sha1(F.coalesce(f["excerpt"], F.lit(""))))


def handler_key(f: Column) -> Column:
    """Handlers merge findings of one id, target, type, resolved file, reason and excerpt."""
    said = [F.coalesce(F.get_json_object(f["trace"], f"$.{k}"), F.lit("")) for k in ("resolved_file", "risk_reason")]
    return F.concat_ws(":", *[F.coalesce(f[c], F.lit("")) for c in ("signature_id", "target", "rule_type")], *said, F.sha1(F.coalesce(f["excerpt"], F.lit(""))))


def scan_handlers(handlers: DataFrame, modules: DataFrame | None = None, files: DataFrame | None = None, config: ScanConfig = ScanConfig(), code: bool = True) -> DataFrame:
    """Results of handlers with findings: their own risks and those of the files that define them."""
    rows = with_installed(strings(handlers, HANDLER), "TO_MODULE_ID", modules)
    df = fenced(rows, own=event_findings(), file_path=virtual_path("b_module_to_module", F.col("ID")))
    if files is not None and config.resolve_handlers:
        places = resolved(rows, files, config.document_root)
        wanted = files.join(places.select("path").distinct(), "path", "left_semi")
        hit = scanned(wanted, config, code=code).where(has_risk(F.col("findings"))).select(F.col("file_path").alias("path"), F.filter("findings", lambda f: f["score"] > 0).alias("__d"))
        facts = places.join(hit, "path").groupBy("ID").agg(F.array_sort(F.collect_list(F.struct("path", "__d"))).alias("__files"))
        df = df.join(facts, "ID", "left")

        def of_file(x):
            d = x["__d"]
            request = F.exists(d, lambda f: f["category"].isin("taint", "php_taint") | F.lower(f["signature_id"]).contains("request") | F.coalesce(f["trace"].rlike('"source":"\\$_(?:GET|POST|REQUEST|COOKIE|FILES)'), F.lit(False)))
            total = F.least(F.greatest(F.aggregate(d, F.lit(0), lambda a, f: a + F.greatest(f["score"], F.lit(0))), F.lit(1)), F.lit(10))
            worst = severity_of(F.aggregate(d, F.lit(0), lambda a, f: F.greatest(a, weight(f["severity"]))))
            names = F.array_join(F.array_distinct(F.transform(d, lambda f: f["signature_id"])), ",")
            first = F.get(F.filter(d, lambda f: f["category"].isin("taint", "php_taint") | F.lower(f["signature_id"]).contains("request")), F.lit(0))
            sink = F.coalesce(F.get_json_object(first["trace"], "$.sink"), F.nullif(F.regexp_extract(first["signature_id"], "request_to_(.+)$", 1), F.lit("")), first["signature_id"], F.lit("unknown"))
            return F.array(
                handler_finding("bitrix_event_handler_file_suspicious", worst, total, risk_reason="resolved_handler_file_suspicious", resolved_file=x["path"], detector_findings_total=F.size(d), detector_signatures=names),
                F.when(request, handler_finding("bitrix_event_request_to_sink", "critical", 10, ["risk:request_input", "risk:dangerous_sink"], risk_reason="request_to_sink", sink=sink, resolved_file=x["path"])),
            )

        extra = F.filter(F.flatten(F.transform(F.coalesce("__files", F.filter(F.col("__files"), lambda x: F.lit(False))), of_file)), lambda f: f.isNotNull())
        df = fenced(df, own=F.concat("own", F.coalesce(extra.cast(FINDINGS), no_findings())))
    df = df.select("ID", "file_path", F.lit(None).cast("string").alias("file_hash"), F.col("own").alias("findings")).where(F.size("findings") > 0)
    df = fenced(df, findings=deduped(F.col("findings"), handler_key))
    df = fenced(df, findings=tagged(F.col("findings"), F.col("file_path"), config.document_root))
    return summed(df, config)
