"""Command line: scan, baseline-create, baseline-update, baseline-check, import-hashes. Exit codes: 0 ok, 1 findings, 2 usage, 3 error, 4 conflict."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from palisade.config import DEFAULT_EXCLUDES, ConfigError, ScanConfig
from palisade.operators import baseline, hashdb, report, tables, whitelist
from palisade.operators.findings import has_risk
from palisade.operators.rules import RULES, external_rules
from palisade.operators.trees import tree_scanned
from palisade.sources import sitefiles, stores
from palisade.streaming.scan import ScanRun


class Usage(Exception):
    pass


class Parser(argparse.ArgumentParser):
    def error(self, message):
        raise Usage(message)


#: Options that go to the configuration as they are, if given.
NUMBERS = ("normalized-hash-max-mb", "ast-max-bytes", "entropy-threshold", "entropy-min-length", "prefix-length")


def parser() -> Parser:
    p = Parser(prog="palisade", allow_abbrev=False)
    p.add_argument("--version", action="version", version="palisade 0.3")
    p.add_argument("command", choices=["scan", "baseline-create", "baseline-update", "baseline-check", "import-hashes"])
    p.add_argument("--document-root", default="")
    p.add_argument("--scan-path", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--scan-profile", default="standard")
    p.add_argument("--profile", default="balanced")
    p.add_argument("--action", default="report")
    p.add_argument("--batch-size", default="50")
    p.add_argument("--max-file-mb", default="100")
    for name in NUMBERS:
        p.add_argument(f"--{name}", default=None)
    for flag in ("force", "entropy", "no-entropy", "no-ast", "no-urls", "no-prefilter", "execute", "json", "no-default-excludes", "resume", "no-normalized-hash", "no-hash-db"):
        p.add_argument(f"--{flag}", action="store_true")
    for option in ("report", "baseline", "feed", "hash-db", "hash-prefixes", "domains", "signatures", "whitelist", "suppressions", "agents", "handlers", "modules", "quarantine", "work", "baseline-store", "baseline-name", "baseline-version"):
        p.add_argument(f"--{option}", default="")
    return p


#: Options of the surveyed command line, which has no commands, and what they are here.
VALUES = {
    "path": "scan-path", "document-root": "document-root", "scan-profile": "scan-profile", "profile": "profile", "action": "action", "signatures": "signatures", "exclude": "exclude", "report": "report", "batch-size": "batch-size",
    "max-file-size-mb": "max-file-mb", "normalized-hash-max-file-size-mb": "normalized-hash-max-mb", "ast-max-file-size": "ast-max-bytes", "entropy-threshold": "entropy-threshold", "entropy-min-length": "entropy-min-length",
    "suspicious-domains": "domains", "malware-hashes": "hash-db", "malware-hash-prefixes": "hash-prefixes", "malware-hash-prefix-length": "prefix-length", "quarantine-path": "quarantine",
}
#: Switches with two flags: name, what a conflict is called, and our flag for either side.
SWITCHES = {
    "ast": ("ast", "", "no-ast"), "prefilter": ("prefilter", "", "no-prefilter"), "normalized-hash": ("normalized_hash", "", "no-normalized-hash"), "entropy": ("entropy", "entropy", "no-entropy"), "url-analyzer": ("url_analyzer", "", "no-urls"),
    "hash-db": ("hash_db", "", "no-hash-db"),
}
PLAIN = ("dry-run", "no-dry-run", "json", "help", "version", "force")
BASELINE = ("baseline-create", "baseline-check", "baseline-update")


def translated(argv: list[str]) -> list[str]:
    """Arguments of the surveyed form (options alone, ``--name value`` or ``--name=value``) as ours, which begin with a command."""
    if not argv or not argv[0].startswith("-"):
        return argv
    given: list[tuple[str, str]] = []
    flags: set[str] = set()
    known = {*PLAIN, *BASELINE, *(f"{side}-{k}" for k in SWITCHES for side in ("enable", "disable"))}
    rest = list(argv)
    if "--help" in rest or "--version" in rest:
        return rest
    while rest:
        name, equals, value = rest.pop(0).partition("=")
        if name == "--" or not name.startswith("--"):
            if name != "--" or rest:
                raise Usage(f"cli_unexpected_argument:{name if name != '--' else rest[0]}")
            break
        name = name[2:]
        if name in known:
            if value:
                raise Usage(f"cli_option_does_not_accept_value:{name}")
            flags.add(name)
        elif name not in VALUES:
            raise Usage(f"cli_unknown_option:{name}")
        else:
            if not equals and not rest:
                raise Usage(f"cli_option_value_required:{name}")
            given.append((VALUES[name], value if equals else rest.pop(0)))
    if {"dry-run", "no-dry-run"} <= flags:
        raise Usage("cli_dry_run_flags_conflict")
    out = []
    for k, (error, on, off) in SWITCHES.items():
        if {f"enable-{k}", f"disable-{k}"} <= flags:
            raise Usage(f"cli_{error}_flags_conflict")
        out += [f"--{on}"] if on and f"enable-{k}" in flags else [f"--{off}"] if f"disable-{k}" in flags else []
    modes = [b for b in BASELINE if b in flags]
    if len(modes) > 1:
        raise Usage("cli_baseline_mode_required")
    if modes == ["baseline-update"] and "force" not in flags:
        raise Usage("cli_force_required_for_baseline_update")
    out += ["--execute"] * ("no-dry-run" in flags) + ["--force"] * ("force" in flags) + ["--json"] * ("json" in flags)
    last = {k: v for k, v in given if k not in ("exclude", "scan-path")}  # a repeated option counts once, with its last value
    several = [(k, v) for k, v in given if k == "exclude"] + [(k, v) for k, v in given if k == "scan-path"][-1:]
    return [*modes, *["scan"] * (not modes), *out, *(f"--{k}={v}" for k, v in [*last.items(), *several])]


def config_of(a) -> ScanConfig:
    if a.entropy and a.no_entropy:
        raise Usage("cli_conflicting_flags:entropy")
    if a.action in ("quarantine", "delete") and a.execute and not a.force:
        raise Usage("cli_destructive_action_requires_force")
    if a.action in ("quarantine", "delete") and a.execute and not a.quarantine:
        raise Usage("cli_missing_value:quarantine")
    root = a.document_root.rstrip("/")
    excludes = [] if a.no_default_excludes else [root + e for e in DEFAULT_EXCLUDES]
    return ScanConfig.of(
        document_root=a.document_root, scan_paths=a.scan_path, exclude_paths=excludes + a.exclude, scan_profile=a.scan_profile, profile=a.profile, action=a.action, batch_size=a.batch_size, max_file_mb=a.max_file_mb,
        dry_run=not a.execute, entropy=a.entropy, entropy_off=a.no_entropy, ast=not a.no_ast, urls=not a.no_urls, prefilter=not a.no_prefilter,
        normalized_hash=not a.no_normalized_hash, hash_db=not a.no_hash_db, **{k: v for n in NUMBERS if (v := getattr(a, k := n.replace("-", "_"))) is not None},
    )


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("palisade").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()


def table(spark, path: str):
    """A JSON-lines or Parquet table."""
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


HASH_ROW = "ord long, hash string, name string, family string, category string, severity string, confidence string, source string, source_ref string, tags array<string>"


def known_hashes(spark, a, config: ScanConfig) -> hashdb.Known | None:
    """The hash database and its prefix index, or their warnings for the first file of the scan; None without one."""
    if not a.hash_db:
        return None
    if not a.hash_db.endswith(".json"):
        return hashdb.Known(hashdb.database(spark.read.parquet(a.hash_db)))
    items, warnings = stores.read_hashes(a.hash_db)
    length, prefixes, more = stores.read_prefixes(a.hash_prefixes)
    text = lambda x, k: None if x.get(k) is None else str(x[k])
    names = [f.split()[0] for f in HASH_ROW.split(", ")]
    rows = [tuple(x["ord"] if k == "ord" else [str(t) for t in x["tags"]] if k == "tags" else text(x, k) for k in names) for x in items]
    db = hashdb.database(spark.createDataFrame(rows, HASH_ROW)) if rows else None
    index = hashdb.prefix_filter(spark.createDataFrame([(p,) for p in prefixes], "prefix string"), length) if prefixes else None
    warnings += more
    first = next((f[0] for f in sitefiles.walk(config) if next(sitefiles.read_rows(*f, 0), None)), None) if warnings else None
    return hashdb.Known(db, index, tuple(warnings), first)


def domain_list(spark, path: str):
    rows = [(x["ord"], x["domain"], x["severity"], [str(t) for t in x["tags"]]) for x in stores.read_domains(path)] if path else []
    return spark.createDataFrame(rows, "ord long, domain string, severity string, tags array<string>") if rows else None


def rules_of(a) -> list:
    if not a.signatures:
        return list(RULES)
    with open(a.signatures, errors="replace") as f:
        return [*RULES, *external_rules(f.read())]


def scan(spark, a, config: ScanConfig):
    """Results of files and, where given, of agents and handlers, whitelisted and suppressed. With a work folder the scan goes in
    steps of ``--batch-size`` files, and can be taken up again."""
    columns = ["file_path", "file_hash", "normalized_hash", "findings", "score", "severity", "status", "tags", "origin"]
    modules = table(spark, a.modules) if a.modules else None
    agents, handlers = (table(spark, x) if x else None for x in (a.agents, a.handlers))
    known, domains = known_hashes(spark, a, config), domain_list(spark, a.domains)
    if a.work:
        run = ScanRun(spark, config, a.work, known, domains, agents, handlers, modules, rules_of(a))
        run.resume_to_completion() if a.resume else run.run_to_completion()
        res = run.results().select(columns)
    else:
        res = tree_scanned(sitefiles.read(spark, config, chunked="false"), config, rules_of(a), known, domains, config.ast, sitefiles.read(spark, config, chunked="true")).withColumn("origin", F.lit("file")).select(columns)
        none, db = F.lit(None).cast("string"), F.lit("db")
        if agents is not None:
            res = res.unionByName(tables.scan_agents(agents, modules, config).withColumn("origin", db).select(columns))
        if handlers is not None:
            files = sitefiles.read(spark, config, chunked="false").where("error IS NULL").select("path", "content")
            found = tables.scan_handlers(handlers, modules, files, config)
            res = res.unionByName(found.withColumn("normalized_hash", none).withColumn("origin", db).select(columns))
    if a.whitelist:
        res = whitelist.whitelisted(res, stores.Rules(a.whitelist).all(), config).select(columns)
    if a.suppressions:
        res = whitelist.suppressed(res, stores.Suppressions(a.suppressions).frame(spark), config).select(columns)
    state, planned = whitelist.planned_action(F.col("status"), has_risk(F.col("findings")), config.action, config.dry_run)
    return res.withColumns({"action_status": state, "planned_action": planned})


def act(res, a, config: ScanConfig) -> dict[str, int]:
    """Move or delete the files of pending results, one after the other: each at most once, whatever tasks repeat."""
    done = {"applied": 0, "failed": 0}
    store = stores.Quarantine(a.quarantine, config.document_root)
    for r in res.where("action_status = 'pending' AND NOT file_path LIKE 'bitrix-db://%'").select("file_path").toLocalIterator():
        try:
            store.take(r["file_path"], "scan", delete=config.action == "delete")
            done["applied"] += 1
        except (OSError, stores.StoreError):
            done["failed"] += 1
    return done


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        argv = translated(sys.argv[1:] if argv is None else list(argv))
        a = parser().parse_args(argv)
        config = config_of(a)
        spark = spark or session()
        if a.command == "import-hashes":
            rows = stores.read_feed(a.feed)
            schema = "ord long, hash string, name string, family string, category string, severity string, tags array<string>"
            keys = ("ord", "hash", "name", "family", "category", "severity", "tags")
            items, counters = hashdb.import_feed(spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], schema))
            items.write.mode("overwrite").parquet(a.hash_db)
            print(json.dumps(counters.first().asDict()))
            return 0
        if a.command.startswith("baseline"):
            snapshot = lambda: baseline.tree_snapshot(sitefiles.read(spark, config), config)
            store, name = stores.Snapshots(a.baseline_store) if a.baseline_store else None, a.baseline_name or "default"
            if a.command == "baseline-check":
                old = store.read(spark, name, a.baseline_version or None) if store else spark.read.parquet(a.baseline)
                got = baseline.counts(baseline.results(baseline.difference(old, snapshot()), config)).first().asDict()
                print(json.dumps(got))
                return 1 if got["findings_total"] else 0
            exists = bool(store.list(name, 1)) if store else False
            if a.command == "baseline-update":
                store.latest(name) if store else spark.read.parquet(a.baseline).schema  # there must be one
            replace = a.force or a.command == "baseline-update"
            if store:
                if exists and not replace:
                    raise stores.StoreError("baseline_exists")
                print(json.dumps({"baseline": name, "version": store.write(snapshot(), name)}))
            else:
                snapshot().write.mode("overwrite" if replace else "errorifexists").parquet(a.baseline)
            return 0
        config.confined()
        res = scan(spark, a, config)
        if a.report:
            res.write.mode("overwrite").json(a.report)
            res = spark.read.schema(res.schema).json(a.report)
        got = report.summary(res).first().asDict()
        if config.action != "report" and not config.dry_run:
            got |= act(res, a, config)
        print(json.dumps(got))
        return report.exit_code(got["found_total"], got["runtime_errors_total"] + got.get("failed", 0))
    except (Usage, ConfigError) as e:
        code = str(e)
        print(code, file=sys.stderr)
        return 4 if code == "scan_already_running" else 3 if code.startswith("scan_path") else 2
    except (OSError, stores.StoreError, AnalysisException) as e:
        print(e, file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
