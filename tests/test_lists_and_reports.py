"""Hash and domain files, prefix bitmaps, definitions, trace projections, pages, snapshots."""

import json
import random

import pytest
from pyspark.sql import functions as F

from palisade import cli
from palisade.config import ScanConfig
from palisade.operators import baseline, findings, hashdb, report, tables
from palisade.schema import FINDINGS
from palisade.sources import stores


def put(folder, name, value):
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))
    return str(folder / name)


# -- files of lists


def test_hash_file_semantics(tmp_path):
    h = "a" * 64
    assert stores.read_hashes(str(tmp_path / "none.json")) == ([], []) and stores.read_hashes("") == ([], [])
    for text, warning in ((" \n", "malware_hashes_empty_or_unreadable"), ("{", "malware_hashes_invalid_json"), ('{"items": 1}', "malware_hashes_invalid_json"), ('{"items": [], "algorithm": "MD5"}', "malware_hashes_unsupported_algorithm:md5")):
        items, warnings = stores.read_hashes(put(tmp_path, "h.json", text))
        assert items == [] and len(warnings) == 1 and warnings[0].startswith(warning)
    items, warnings = stores.read_hashes(put(tmp_path, "h.json", {"algorithm": "SHA256", "source": {"name": "feed"}, "items": [{"hash": h, "tags": "x"}, 3, {"hash": h, "source": "own", "tags": ["T"]}]}))
    assert warnings == [] and [(x["ord"], x["source"], x["tags"]) for x in items] == [(0, "feed", []), (2, "own", ["T"])]
    assert stores.read_prefixes(put(tmp_path, "p.json", {"prefix_length": 40, "prefixes": ["ab"]})) == (12, ["ab"], [])
    assert stores.read_prefixes(put(tmp_path, "p.json", {"prefix_length": "x", "prefixes": []}))[0] == 8
    assert stores.read_prefixes(str(tmp_path / "none.json")) == (8, [], [])


def test_domain_file_semantics(tmp_path):
    items = [{"domain": "HTTPS://Bad.Example.org:80/x", "severity": "odd"}, {"domain": "b.example"}, {"domain": " "}, 7, {"domain": "bad.example.org.", "severity": "LOW", "tags": ["t"]}]
    assert [(x["ord"], x["domain"], x["severity"], x["tags"]) for x in stores.read_domains(put(tmp_path, "d.json", {"items": items}))] == [(0, "bad.example.org", "low", ["t"]), (1, "b.example", "high", [])]
    assert stores.read_domains(put(tmp_path, "d.json", "{")) == [] == stores.read_domains(str(tmp_path / "none.json"))


def test_database_keeps_what_items_say(spark):
    h = "b" * 64
    rows = [(0, h, "old", None, None, None, None), (1, f" {h.upper()} ", None, "fam", "src", "HIGH", ["A ", ""])]
    db = hashdb.database(spark.createDataFrame(rows, "ord long, hash string, name string, family string, source string, severity string, tags array<string>"))
    got = db.first().asDict()
    assert got == {"hash": h, "name": "Known malware", "family": "fam", "category": "", "severity": "high", "confidence": "high", "source": "src", "source_ref": "", "tags": ["A ", ""]}
    files = spark.createDataFrame([("/a", h), ("/b", "c" * 64)], "path string, file_hash string")
    out = {r.path: r.hash_findings for r in hashdb.with_known(files, hashdb.Known(db, None, ("w1", "w2"), "/b")).collect()}
    assert [f.signature_id for f in out["/b"]] == ["hash_db_runtime_warning"] * 2 and [f.excerpt for f in out["/b"]] == ["w1", "w2"]
    (f,) = out["/a"]
    assert (f.signature_id, f.excerpt, f.target, f.score, f.severity) == ("known_malware_hash_match", h[:16] + "...", "file_hash", 100, "critical")
    assert f.tags[2:] == ["a"] and json.loads(f.trace)["matched_tags"] == ["A ", ""] and json.loads(f.trace)["matched_severity"] == "high"


@pytest.mark.parametrize("length", [8, 10, 12])
def test_prefix_bitmaps_equal_semi_join(spark, length):
    r = random.Random(length)
    digest = lambda: "".join(r.choice("0123456789abcdef") for _ in range(64))
    known, others = [digest() for _ in range(500)], [digest() for _ in range(1500)]
    db = hashdb.database(spark.createDataFrame([(h,) for h in known], "hash string").selectExpr("hash", "'m' name"))
    listed = [h[:length] for h in known[:300]] + [h[:length].upper() for h in known[300:310]] + ["xyz", known[400][:length] + "0", known[401][: length - 1]]
    index = hashdb.prefix_filter(spark.createDataFrame([(p,) for p in listed], "prefix string"), length)
    rows = spark.createDataFrame([(h,) for h in known + others + known[:5]], "hash string")
    want = sorted(h for h in known + others + known[:5] if h[:length] in {p.lower() for p in listed if len(p) == length})
    assert sorted(x.hash for x in hashdb.gated(rows, index).collect()) == want
    counts = hashdb.gate_counts(rows, index).first()
    assert counts.hashes == 2005 and 0.8 * (2005 - len(want)) < counts.skipped <= 2005 - len(want)
    assert index.n_bits % hashdb.BUCKET_BITS == 0 and sorted(x.hash for x in hashdb.gated(db, index).collect()) == sorted(set(want))
    plan = hashdb.gated(rows, index)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_prefix_filter_over_many_buckets_and_off(spark, monkeypatch):
    monkeypatch.setattr(hashdb, "BROADCAST_BUCKETS", 0)
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    index = hashdb.prefix_filter(rows.where("hash < '8'").select(F.substring("hash", 1, 8).alias("prefix")))
    assert index.n_bits > 3 * hashdb.BUCKET_BITS
    assert hashdb.gated(rows, index).count() == rows.where("hash < '8'").count()
    off = hashdb.prefix_filter(spark.createDataFrame([("zz",)], "prefix string"))
    assert not off.active and hashdb.gated(rows, off).count() == 20_000 and hashdb.gate_counts(rows, off).first().skipped == 0


# -- definitions


def test_handlers_meet_definitions(spark):
    files = {
        "/s/local/php_interface/init.php": "<?php FUNCTION Go() {} class A\\B {} trait Tee { function run ($x) {} }",
        "/s/bitrix/modules/shop/include.php": "<?php class Cart{ function  run() {} function\n_x9 () {} } myfunction nope() {} function &ref() {}",
        "/S/Bitrix/modules/shop/lib/deep/c.php": "<?php final class \xe9t\xe9 { function caf\xe9() {} }",
        "/s/bitrix/modules/shop/other/c.php": "<?php class Cart { function run() {} }",
        "/s/local/modules/sh.op/lib/a.php": "<?php class Cart { function run() {} }",
    }
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    rows = [
        ("1", "shop", "Cart", "run"), ("2", "shop", "NS\\cart", "RUN"), ("3", "shop", "", "go"), ("4", "shop", "Tee", "run"), ("5", "bad id", "Cart", "run"), ("6", "", "", "run"), ("7", "shop", "Cart", "nope"), ("8", "shop", "", "ref"),
        ("9", "shop", "\xe9t\xe9", "caf\xe9"), ("10", "shop", "Cart", ""), ("11", "sh.op", "Cart", "run"), ("12", "shop", "Cart", "run("), ("13", "shop", "A", "go"), ("14", "shop", "Cart\\", "_x9"),
    ]
    handlers = spark.createDataFrame(rows, "ID string, TO_MODULE_ID string, TO_CLASS string, TO_METHOD string")
    got = sorted((int(r.ID), r.path) for r in tables.resolved(tables.strings(handlers, tables.HANDLER), df, "/s").collect())
    init, shop, deep, dotted = (p for i, p in enumerate(files) if i != 3)
    assert got == sorted([(1, shop), (2, shop), (3, init), (4, init), (6, init), (9, deep), (11, dotted), (13, init), (14, shop)])


def test_handler_findings_merge_by_file_and_reason(spark):
    def f(sig, resolved, reason, line):
        return {"signature_id": sig, "target": "db_event", "rule_type": "bitrix_db", "excerpt": "e", "trace": json.dumps({"resolved_file": resolved, "risk_reason": reason}), "line": line}

    rows = [f("s", "/a", "r", 0), f("s", "/b", "r", 1), f("s", "/a", "r", 2), f("s", "/a", "q", 3), f("t", "/a", "r", 4)]
    df = spark.createDataFrame([(rows,)], f"f {FINDINGS}")
    assert [x.line for x in df.select(findings.deduped(F.col("f"), tables.handler_key)).first()[0]] == [0, 1, 3, 4]
    assert [x.line for x in df.select(findings.deduped(F.col("f"), tables.agent_key)).first()[0]] == [0, 4]


# -- reports


def results(spark):
    handlers = spark.createDataFrame([("7", "main", "OnProlog", "gone", "CFoo", "bar", "5"), ("8", "main", "OnX", "", "", "shell_exec", "6")], "ID string, FROM_MODULE_ID string, MESSAGE_ID string, TO_MODULE_ID string, TO_CLASS string, TO_METHOD string, SORT string")
    agents = spark.createDataFrame([("3", "gone", "eval($x);", "Y", "soon")], "ID string, MODULE_ID string, NAME string, ACTIVE string, NEXT_EXEC string")
    modules = spark.createDataFrame([("main",)], "module_id string")
    files = spark.createDataFrame([("/s/upload/a.php", "<?php eval($_POST['a']);")], "path string, content string")
    columns = ["file_path", "file_hash", "normalized_hash", "findings", "score", "severity", "status", "tags"]
    config = ScanConfig.of(document_root="/s")
    of_handlers = tables.scan_handlers(handlers, modules).withColumn("normalized_hash", F.lit(None).cast("string"))
    return findings.scanned(files, config).select(columns).unionByName(of_handlers.select(columns)).unionByName(tables.scan_agents(agents, modules).select(columns))


def test_projection_has_35_columns_from_the_trace(spark):
    df = report.projection(results(spark), "scan1", "/s")
    assert len(df.columns) == 35 and dict(df.dtypes)["db_trace"] == "variant"
    rows = df.withColumns({"trace": F.to_json("db_trace"), "of": F.try_variant_get("scan_result", "$.file_path", "string"), "print": F.try_variant_get("finding", "$.fingerprint", "string")}).drop("db_trace", "scan_result", "finding").collect()
    by = {(r.file_path, r.signature_id): r for r in rows}
    x = by["bitrix-db://b_module_to_module/7", "bitrix_event_critical_hook_unknown_module"]
    assert (x.entity_type, x.db_id, x.db_module_id, x.db_from_module_id, x.db_message_id, x.db_to_class, x.db_to_method, x.db_sort, x.risk_reason) == ("bitrix_event_handler", "7", "gone", "main", "OnProlog", "CFoo", "bar", "5", "module_not_installed")
    a = by["bitrix-db://b_agent/3", "bitrix_agent_unknown_module"]
    assert (a.entity_type, a.db_id, a.db_module_id, a.db_active, a.db_next_exec) == ("bitrix_agent", "3", "gone", "Y", "soon")
    inner = by["bitrix-db://b_agent/3", "php_eval"]
    assert inner.entity_type == "bitrix_agent" and json.loads(inner.trace)["detector_target"] == "content"
    f = by["/s/upload/a.php", "php_eval"]
    assert f.entity_type == f.db_id == f.normalized_hash[:0] == "" and f.trace == "{}" and f.print == f.finding_fingerprint and f.of == f.file_path and "risk:executable_upload" in f.tags
    assert len({r.id for r in rows}) == len(rows)


def test_baseline_projection(spark):
    old = spark.createDataFrame([("/s/a.php", "1")], "path string, content string")
    new = spark.createDataFrame([("/s/upload/d.php", "4")], "path string, content string")
    c = ScanConfig.of(document_root="/s")
    rows = report.baseline_projection(baseline.results(baseline.difference(baseline.snapshot(old, c), baseline.snapshot(new, c)), c)).collect()
    assert rows[0].asDict().keys() == {"ID", "FILE", "SIGNATURE", "SEVERITY", "SCORE", "TAGS", "EXCERPT"}
    assert sorted((r.FILE, r.SIGNATURE, r.SCORE) for r in rows) == [("/s/a.php", "baseline_deleted_file", 3), ("/s/upload/d.php", "baseline_critical_path_changed", 5), ("/s/upload/d.php", "baseline_new_file", 3), ("/s/upload/d.php", "baseline_php_in_upload", 9)]


@pytest.mark.parametrize("field,descending", [("score", True), ("signature_id", False), ("entropy", True), ("nonsense", False)])
def test_pages_equal_slices_of_the_whole_order(spark, field, descending):
    rows = spark.range(100_000).select(F.concat(F.lit("/f"), (F.col("id") % 20_000)).alias("file_path"), F.lit("x").alias("status"), (F.col("id") / 20_000).cast("int").alias("pos"), (F.col("id") % 7).cast("int").alias("score"), F.concat(F.lit("s"), F.col("id") % 3).alias("signature_id"), F.when(F.col("id") % 2 == 0, (F.col("id") % 5) / 2).alias("entropy")).cache()
    whole = [(r.file_path, r.pos) for r in report.ordered(rows, field, descending).limit(420).collect()]
    got = []
    for page in report.pages(rows, field, descending, 60):
        got += [(r.file_path, r.pos) for r in page]
        if len(got) >= 420:
            break
    assert got == whole
    last = rows.where("file_path = '/f9'").withColumn("__key", report.sort_key("score")).first()
    plan = report.page_after(rows, "score", True, 60, report.Place(last["__key"], last.file_path, last.pos))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange range" not in plan


def test_pages_end(spark):
    rows = spark.createDataFrame([("/a", 0, 1), ("/a", 1, 1), ("/b", 0, None)], "file_path string, pos int, score int")
    assert [[(r.file_path, r.pos) for r in p] for p in report.pages(rows, size=2)] == [[("/a", 0), ("/a", 1)], [("/b", 0)]]
    assert list(report.pages(rows.limit(0))) == []


def test_lists_of_reports_and_exceptions():
    reports = [{"scan_id": "b", "started_at": "2", "found_total": "10"}, {"scan_id": "a", "started_at": "2", "found_total": 9}, {"scan_id": "c", "started_at": "3"}]
    assert [r["scan_id"] for r in stores.sorted_reports(reports)] == ["c", "b", "a"]
    assert [r["scan_id"] for r in stores.sorted_reports(reports, "found_total", "asc")] == ["c", "a", "b"]
    rows = stores.exception_rows([{"id": "1", "active": True, "type": "path", "path": "/z", "created_at": "1"}, {"id": "2", "active": False, "type": "hash", "hash": "aa", "created_at": "3"}], [{"fingerprint": "ff", "created_at": "2"}])
    assert [r["id"] for r in rows] == ["2", "suppression:ff", "1"]
    assert [r["value"] for r in stores.exception_rows([{"id": "1", "type": "path", "path": "/z"}], [{"fingerprint": "ff"}], "value", "asc")] == ["/z", "ff"]


def test_bulk_actions_on_report_rows(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for n in ("a.php", "b.php"):
        (tmp_path / "s" / n).write_text("<?php eval($x); base64_decode($y);")
    root = str(tmp_path / "s")
    files = spark.createDataFrame([(f"{root}/{n}", "<?php eval($x); base64_decode($y);") for n in ("a.php", "b.php", "gone.php")], "path string, content string")
    rows = report.projection(findings.scanned(files, ScanConfig.of(document_root=root)), "s1", root).select("id", "file_path", "file_hash", "signature_id", "finding_fingerprint").cache()
    rules, marks = stores.Rules(str(tmp_path / "rules.json")), stores.Suppressions(str(tmp_path / "marks.json"))
    assert stores.bulk_action(rows, "whitelist_signature", rules) == {"done": 2, "failed": 0} and len(rules.all()) == 2
    one = [r["id"] for r in rows.where("signature_id = 'php_eval'").limit(1).collect()]
    assert stores.bulk_action(rows, "whitelist_file_signature", rules, ids=[*one, "nothing"]) == {"done": 1, "failed": 0}
    assert rules.all()[-1]["type"] == "file_signature" and rules.all()[-1]["path"].endswith(".php")
    assert stores.bulk_action(rows, "whitelist_hash", rules)["done"] == 1 and stores.bulk_action(rows, "whitelist_path", rules)["done"] == 3
    assert stores.bulk_action(rows, "suppress_finding", marks=marks)["done"] == len(marks.all()) == rows.select("finding_fingerprint").distinct().count()
    assert stores.bulk_action(rows, "quarantine_file", quarantine=stores.Quarantine(str(tmp_path / "q"), root)) == {"done": 2, "failed": 1}
    assert not (tmp_path / "s/a.php").exists()
    with pytest.raises(stores.StoreError, match="report_action_unknown"):
        stores.bulk_action(rows, "explode")


# -- snapshots


def test_snapshots_have_versions_and_a_pointer_that_moves_last(spark, tmp_path):
    store = stores.Snapshots(str(tmp_path / "b"))
    rows = lambda *x: baseline.snapshot(spark.createDataFrame(list(x), "path string, content string"), ScanConfig.of(document_root="/s"))
    with pytest.raises(stores.StoreError, match="baseline_not_found"):
        store.latest()
    one = store.write(rows(("/s/a.php", "1"), ("/s/b.php", "2")))
    two = store.write(rows(("/s/a.php", "1"), ("/s/c.php", "3")))
    assert store.latest() == two and [v["version"] for v in store.list()] == [two, one] and store.list(limit=1)[0]["files"] == 2
    assert sorted((r.relative_path, r.change) for r in store.difference(spark, "default", one).collect()) == [("/b.php", "deleted"), ("/c.php", "new")]
    assert store.difference(spark, "default", two, one).where("change = 'new'").first().relative_path == "/b.php"
    boom = rows(("/s/a.php", "1")).withColumn("size", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        store.write(boom)
    assert store.latest() == two and len(store.list()) == 2 and store.read(spark).count() == 2
    store.write(rows(("/s/x.php", "1")), "other")
    assert store.names() == ["default", "other"] and store.list("nothing") == []
    for bad in ("../x", "..", ""):
        with pytest.raises(stores.StoreError, match="baseline_name_invalid"):
            store.latest(bad)
    for i in range(22):
        stores.write_json(str(tmp_path / "b" / "other" / f"{i:020d}_x.json"), {"version": f"{i:020d}_x"})
    assert len(store.list("other")) == 20


# -- command line


def test_cli_named_baselines_steps_and_warnings(spark, tmp_path, capsys):
    site = tmp_path / "site"
    (site / "upload").mkdir(parents=True)
    (site / "b.php").write_text("<?php eval($_POST['a']);")
    (site / "a.php").write_text("<?php echo 'é';")
    said = lambda: json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    base = ["--document-root", str(site), "--baseline-store", str(tmp_path / "store"), "--baseline-name", "week"]
    assert cli.main(["baseline-create", *base], spark) == 0
    first = said()["version"]
    assert cli.main(["baseline-create", *base], spark) == 3 and cli.main(["baseline-check", *base], spark) == 0
    (site / "upload/n.php").write_text("<?php")
    assert cli.main(["baseline-check", *base], spark) == 1 and cli.main(["baseline-update", *base], spark) == 0
    assert cli.main(["baseline-check", *base], spark) == 0 and cli.main(["baseline-check", *base, "--baseline-version", first], spark) == 1
    capsys.readouterr()
    scan = ["scan", "--document-root", str(site), "--no-ast"]
    assert cli.main(scan, spark) == 1
    plain = said()
    assert cli.main([*scan, "--work", str(tmp_path / "work"), "--batch-size", "2"], spark) == 1
    stepped = said()
    assert stepped == plain and plain["processed_total"] == 3
    assert cli.main([*scan, "--hash-db", put(tmp_path, "h.json", "{"), "--hash-prefixes", put(tmp_path, "p.json", " ")], spark) == 1
    warned = said()
    assert warned["informational_files"] == plain["informational_files"] + 1 and warned["informational_total"] == plain["informational_total"] + 2
    assert cli.main([*scan, "--hash-db", str(tmp_path / "none.json"), "--domains", put(tmp_path, "d.json", "{")], spark) == 1 and said() == plain


def test_cli_takes_the_surveyed_form(spark, tmp_path, capsys):
    assert cli.translated(["scan", "--path", "x"]) == ["scan", "--path", "x"] and cli.translated([]) == []
    got = cli.translated(["--document-root=/s", "--path", "/s/a", "--exclude", "/x", "--exclude=/y", "--profile", "strict", "--profile=balanced", "--disable-ast", "--enable-entropy", "--entropy-threshold", "4,5", "--no-dry-run", "--force"])
    assert got[0] == "scan" and set(got[1:]) == {"--document-root=/s", "--scan-path=/s/a", "--exclude=/x", "--exclude=/y", "--profile=balanced", "--no-ast", "--entropy", "--entropy-threshold=4,5", "--execute", "--force"}
    config = cli.config_of(cli.parser().parse_args([x for x in got if x not in ("--execute", "--force")]))
    assert (config.ast, config.entropy, config.entropy_threshold, config.scan_paths) == (False, True, 4.5, ("/s/a",))
    assert cli.translated(["--baseline-update", "--force"]) == ["baseline-update", "--force"]
    bad = {
        "--what": "cli_unknown_option:what", "--json=1": "cli_option_does_not_accept_value:json", "--profile": "cli_option_value_required:profile", "--path=/a file": "cli_unexpected_argument:file", "-- file": "cli_unexpected_argument:file",
        "--dry-run --no-dry-run": "cli_dry_run_flags_conflict", "--enable-ast --disable-ast": "cli_ast_flags_conflict", "--enable-hash-db --disable-hash-db": "cli_hash_db_flags_conflict", "--baseline-create --baseline-check": "cli_baseline_mode_required",
        "--baseline-update": "cli_force_required_for_baseline_update",
    }
    for text, error in bad.items():
        with pytest.raises(cli.Usage, match=error):
            cli.translated(text.split())
        assert cli.main(text.split(), spark) == 2
    (tmp_path / "a.php").write_text("<?php eval($_POST['a']);")
    assert cli.main(["--document-root", str(tmp_path), "--disable-ast", "--disable-url-analyzer", "--batch-size=10"], spark) == 1
