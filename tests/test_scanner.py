import base64
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from palisade import cli
from palisade.config import ConfigError, ScanConfig, truthy
from palisade.operators import baseline, findings, hashdb, report, tables, whitelist
from palisade.operators.code import code_findings
from palisade.operators.rules import RULES, external_rules, rule_findings
from palisade.sources import sitefiles, stores
from palisade.streaming.scan import ScanRun, scan_stream_once


def ids(df, path=None):
    rows = df.collect()
    return [f["signature_id"] for r in rows if path is None or r["file_path"] == path for f in r["findings"]]


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


CODE = {
    "eval($_POST['x']);": ["php_ast_dangerous_call_eval", "taint_request_to_eval"],
    "system($_GET['c']);": ["php_ast_dangerous_call_system", "taint_request_to_system"],
    "$f = 'ev'.'al'; $f($x);": ["php_ast_dynamic_function_call"],
    "eval(gzinflate(base64_decode('x')));": ["php_ast_dangerous_call_eval", "php_ast_encoded_execution_chain"],
    "include $_GET['p'];": ["php_ast_dangerous_call_include", "taint_request_to_include"],
    "$a = $_GET['x']; $b = $a; exec($b);": ["php_ast_dangerous_call_exec", "taint_request_to_exec"],
    "function r($c) { system($c); } r($_GET['c']);": ["php_ast_dangerous_call_system", "taint_request_to_system"],
    "function g() { return $_POST['x']; } eval(g());": ["php_ast_dangerous_call_eval", "taint_request_to_eval"],
    "foreach ($_GET as $k => $v) { passthru($v); }": ["php_ast_dangerous_call_passthru", "taint_request_to_passthru"],
    "$d = [$_GET['a']]; popen($d[0]);": ["php_ast_dangerous_call_popen", "taint_request_to_popen"],
    "$o->query($_GET['q']);": ["taint_request_to_method_query"],
    "Foo::system($_GET['q']);": ["taint_request_to_static_system"],
    "$x = (int)$_GET['x']; system($x);": ["php_ast_dangerous_call_system"],
    "$b = file_get_contents('php://input'); eval($b);": ["php_ast_dangerous_call_eval", "taint_request_to_eval"],
    "curl_setopt($c, CURLOPT_URL, $_GET['u']);": ["taint_request_to_curl_setopt_url"],
    "$x = base64_decode($_POST['a']); assert($x);": ["php_ast_dangerous_call_assert", "taint_request_to_assert"],
    "$_GET['f']($x);": ["php_ast_superglobal_callable", "taint_request_to_dynamic_call"],
    "echo 'unfinished": [],
    "class C { function m($x) { eval($_POST['a']); } }": ["php_ast_dangerous_call_eval", "taint_request_to_eval"],
    "class C { public $p; function m() { $this->p = $_GET['a']; exec($this->p); passthru($this->q); } }": ["php_ast_dangerous_call_exec", "php_ast_dangerous_call_passthru", "taint_request_to_exec"],
    "function a($x) { return b($x); } function b($y) { return $y; } $f = a($_GET['q']); system(trim($f));": ["php_ast_dangerous_call_system", "taint_request_to_system"],
    "function loop($x) { return loop($x); } exec(loop(1)); $c = $c; exec($c);": ["php_ast_dangerous_call_exec"],
    "$x = filter_var($_GET['x'], FILTER_VALIDATE_INT); system($x); system($_SERVER['DOCUMENT_ROOT']); system($_SERVER['HTTP_X']);": ["php_ast_dangerous_call_system", "taint_request_to_system"],
}


@pytest.mark.parametrize("source", CODE)
def test_code_findings(source):
    got = code_findings("<?php " + source)
    assert sorted({f["signature_id"] for f in got}) == sorted(CODE[source])
    for f in got:
        if f["category"] == "php_taint":
            assert f["score"] == 10 and json.loads(f["trace"])["risk"]["score"] == 10


def test_trace_of_request_data():
    text = "<?php\n$a = base64_decode($_POST['a']);\nfunction r($c) {\nsystem('x' . $c);\n}\nr($a);"
    (f,) = [x for x in code_findings(text) if x["category"] == "php_taint"]
    t = json.loads(f["trace"])
    assert (t["source"], t["source_line"], t["sink"], t["sink_line"], f["line"]) == ("$_POST", 2, "system", 4, 4)
    assert [x["name"] for x in t["transforms"]] == ["base64_decode", "param:c", "concat"] and f["excerpt"].startswith("source: $_POST -> transform: base64_decode")


def test_code_without_tag_keeps_lines():
    assert [(f["signature_id"], f["offset"]) for f in code_findings("popen($x, 'r');")] == [("php_ast_dangerous_call_popen", 2)]


def test_scan_scores_dedupe_and_tags(spark):
    files = {"/s/upload/a.php": "<?php eval($_POST['a']); eval($b);", "/s/b.php": "<?php echo 1;", "/s/c.txt": "eval(1)"}
    got = {r.file_path: r for r in findings.scanned(frame(spark, files), ScanConfig.of(document_root="/s"), code=True).collect()}
    a = got["/s/upload/a.php"]
    assert [f.signature_id for f in a.findings][:2] == ["bitrix_php_in_upload", "php_eval"] and a.status == "malicious" and a.severity == "critical"
    assert {"path:upload", "risk:executable_upload", "engine:ast", "engine:taint", "risk:request_input"} <= set(a.tags)
    assert got["/s/b.php"].score == 0 and got["/s/b.php"].status == "clean" and got["/s/b.php"].severity == "low"
    assert got["/s/c.txt"].findings == []


def test_each_rule_has_a_case(spark):
    from palisade.plans import overlay as O

    files = {d.replace("{id}", "1") + f"{i}/" + n.replace("{id}", "1"): p for i, (d, n, p) in enumerate(O.TEMPLATES)}
    df = frame(spark, files).select(F.explode(rule_findings(F.col("path"), F.col("content"))).alias("f"))
    fired = {r[0] for r in df.select("f.signature_id").distinct().collect()}
    assert len(RULES) == 27
    assert fired >= {r.id for r in RULES} - {"bitrix_init_dynamic_execution", "bitrix_suspicious_access_php"}


def test_external_signatures():
    got = external_rules("# c\n/evil_marker/i # note\n\nbad\n~x+y~\n#")
    assert [(r.id, r.pattern, r.flags) for r in got] == [("external_signature_1", "evil_marker", "i"), ("external_signature_3", "x+y", "")]


def test_htaccess(spark):
    root = "AddHandler application/x-httpd-php .jpg\nphp_value auto_prepend_file x\n# eval(\n<?php x\nRewriteCond %{HTTP_USER_AGENT} bot\nRewriteRule ^ /x [L]\nRewriteRule ^wp-admin - [F]"
    up = "SetHandler application/x-httpd-php\nRequire all granted\nAddHandler application/x-httpd-php .jpg .png"
    df = findings.scanned(frame(spark, {"/s/.htaccess": root, "/s/upload/.htaccess": up, "/s/x.php": root}), ScanConfig())
    assert ids(df, "/s/.htaccess") == ["htaccess_php_handler_for_static_ext", "htaccess_auto_prepend_append", "htaccess_embedded_code", "htaccess_foreign_cms_marker", "htaccess_suspicious_rewrite", "htaccess_suspicious_rewrite"]
    # two extensions on one line are not taken, as in the original's matching
    assert ids(df, "/s/upload/.htaccess") == ["htaccess_php_handler_for_static_ext", "htaccess_access_bypass"]


def test_entropy_and_urls(spark):
    r = random.Random(7)
    blob = base64.b64encode(bytes(r.randrange(256) for _ in range(480))).decode()
    files = {"/s/a.php": f"<?php $x = '{blob}';", "/s/b.php": f"<?php eval(base64_decode({blob}));", "/s/c.php": "<?php echo 1;", "/s/d.html": '<iframe src="http://a.bad.example.org/x."></iframe>', "/s/e.html": "see http://a.example.com/ and http://b.example.com/", "/s/f.html": "see https://ok.example.com/page"}
    lists = spark.createDataFrame([(0, "example.org", "critical", ["phish"])], "ord int, domain string, severity string, tags array<string>")
    got = {x.file_path: x for x in findings.scanned(frame(spark, files), ScanConfig.of(entropy=True), domains=lists).collect()}
    high = [f for f in got["/s/b.php"].findings if f.category == "entropy"]
    assert [(f.severity, f.score, f.confidence, f.length) for f in high] == [("high", 7, "medium", 640)] and high[0].entropy >= 4.7
    assert [f.severity for f in got["/s/a.php"].findings if f.category == "entropy"] == ["medium", "medium"] or [f.score for f in got["/s/a.php"].findings if f.category == "entropy"][0] == 5
    assert [f.signature_id for f in got["/s/d.html"].findings] == ["html_iframe", "external_url_detected", "suspicious_domain_match", "suspicious_iframe_url"]
    match = got["/s/d.html"].findings[2]
    assert match.score == 10 and match.domain == "a.bad.example.org" and "domain:phish" in match.tags
    assert got["/s/e.html"].findings == [] and [f.score for f in got["/s/f.html"].findings] == [0]
    one = report.summary(spark.createDataFrame([got["/s/f.html"]], findings.scanned(frame(spark, files), ScanConfig()).schema)).first()
    assert (one.found_total, one.informational_files) == (0, 1)


def test_hash_database_and_feed(spark):
    files = frame(spark, {"/s/a.php": "x", "/s/b.php": "y"})
    h = files.select("path", F.sha2("content", 256).alias("h")).where("path = '/s/a.php'").first().h
    items = spark.createDataFrame([(0, h.upper(), "old", "f", "c", "low"), (1, h, "new", "f", "c", "nope"), (2, "bad", "n", "f", "c", "low")], "ord int, hash string, name string, family string, category string, severity string")
    db = hashdb.database(items)
    assert [tuple(r) for r in db.select("hash", "name", "severity").collect()] == [(h, "new", "critical")]
    found = hashdb.hash_findings(hashdb.matches(files, db, hashdb.prefixes(db)))
    df = findings.scanned(files, ScanConfig(), hash_findings=found)
    assert {(r.file_path, r.score) for r in df.collect()} == {("/s/a.php", 100), ("/s/b.php", 0)}
    other = spark.createDataFrame([("0" * 8,)], "prefix string")
    assert hashdb.matches(files, db, other).count() == 0
    feed = spark.createDataFrame([(0, h, None, None, None, "medium", None), (1, h, None, None, None, "low", None), (2, "zz", None, None, None, None, None)], "ord int, hash string, name string, family string, category string, severity string, tags array<string>")
    got, counters = hashdb.import_feed(feed)
    assert got.first().severity == "high" and got.first().family == "unknown"
    assert counters.first().asDict() == {"total": 3, "imported": 1, "invalid": 1, "duplicates": 1}


def test_baseline(spark):
    config = ScanConfig.of(document_root="/s")
    old = frame(spark, {"/s/a.php": "1", "/s/b.php": "x y", "/s/c.php": "3", "/s/bitrix/php_interface/init.php": "i"})
    new = frame(spark, {"/s/a.php": "2", "/s/b.php": "x  y", "/s/upload/d.php": "4", "/s/bitrix/php_interface/init.php": "j", "/s/bitrix/tools/t.php": "5"})
    res = baseline.results(baseline.difference(baseline.snapshot(old, config), baseline.snapshot(new, config)), config)
    got = {r.relative_path: r for r in res.collect()}
    assert {k: v.change for k, v in got.items()} == {"/a.php": "modified", "/b.php": "modified", "/c.php": "deleted", "/upload/d.php": "new", "/bitrix/php_interface/init.php": "modified", "/bitrix/tools/t.php": "new"}
    assert got["/b.php"].normalized_hash_changed is False and got["/a.php"].normalized_hash_changed is True
    assert [f.signature_id for f in got["/upload/d.php"].findings] == ["baseline_new_file", "baseline_critical_path_changed", "baseline_php_in_upload"]
    one = baseline.counts(res).first()
    assert (one.new_files, one.modified_files, one.deleted_files, one.critical_changes) == (2, 3, 1, 3)


def test_whitelist_suppression_and_actions(spark):
    files = frame(spark, {"/s/a.php": "<?php eval($x); base64_decode($y);"})
    res = findings.scanned(files, ScanConfig.of(document_root="/s"))
    assert res.first().score == 7
    out = whitelist.whitelisted(res, [{"id": "1", "type": "file_signature", "signature_id": "php_eval", "path": "/S/a.php"}]).first()
    assert out.score == 2 and out.status == "low_risk" and out.ignored[0].rule_id == "1" and set(res.first().tags) == set(out.tags)
    out = whitelist.whitelisted(res, [{"id": "2", "type": "path_regex", "pattern": "^/s/.*\\.php$"}]).first()
    assert out.score == 0 and out.status == "clean"
    with pytest.raises(whitelist.RuleError):
        whitelist.checked({"type": "path_regex", "pattern": "("})
    elsewhere = findings.scanned(frame(spark, {"/other/root/a.php": "<?php eval($x); base64_decode($y);"}), ScanConfig.of(document_root="/other/root"))
    marks = report.finding_rows(res).where("signature_id = 'php_eval'").select("fingerprint")
    assert whitelist.suppressed(elsewhere, marks).first().score == 2
    for action, dry, want in (("report", True, ("reported", None)), ("delete", True, ("dry_run", "delete")), ("odd", True, ("unsupported", "odd"))):
        a, p = whitelist.planned_action(F.col("status"), findings.has_risk(F.col("findings")), action, dry)
        assert tuple(res.select(a, p).first()) == want


def test_tables(spark):
    agents = spark.createDataFrame([("1", "main", "CFoo::Run();", "Y"), ("2", "main", "eval(base64_decode('x'));", "Y"), ("3", "main", "system($_GET['a']);", "N"), ("4", "gone", "CFoo::Run();", "N")], "ID string, MODULE_ID string, NAME string, ACTIVE string")
    modules = spark.createDataFrame([("main",)], "module_id string")
    got = {r.ID: [f.signature_id for f in r.findings] for r in tables.scan_agents(agents, modules).collect()}
    assert set(got) == {"2", "3", "4"} and got["4"] == ["bitrix_agent_unknown_module"]
    assert got["2"][-2:] == ["bitrix_agent_encoded_payload", "bitrix_agent_dangerous_php_execution"] and got["2"][0].startswith("php_") and "bitrix_agent_request_to_sink" in got["3"]
    rows = [("1", "main", "OnCustom", "main", "CFoo", "run", "1"), ("2", "main", "OnProlog", "gone", "CFoo", "bar", "1"), ("3", "main", "OnX", "main", "", "shell_exec", "1"), ("4", "main", "OnX", "", "CEvil", "go", "1")]
    handlers = spark.createDataFrame(rows, "ID string, FROM_MODULE_ID string, MESSAGE_ID string, TO_MODULE_ID string, TO_CLASS string, TO_METHOD string, SORT string")
    files = frame(spark, {"/s/local/php_interface/init.php": "<?php class CEvil { function go() {} } eval($_POST['a']);"})
    out = {r.ID: r for r in tables.scan_handlers(handlers, modules, files, ScanConfig.of(document_root="/s")).collect()}
    assert set(out) == {"2", "3", "4"} and (out["2"].score, out["2"].severity) == (7, "high")
    assert [f.signature_id for f in out["4"].findings] == ["bitrix_event_empty_module", "bitrix_event_handler_file_suspicious", "bitrix_event_request_to_sink"]
    twice = spark.createDataFrame([("7", "main", "eval($x);", "Y"), ("7", "main", "shell_exec($x);", "Y"), ("8", "", "  ", "Y"), ("9", "gone", None, "Y")], agents.schema)
    assert sorted((r.ID, r.findings[-1].excerpt[:4]) for r in tables.scan_agents(twice, modules).collect()) == [("7", "eval"), ("7", "shel")]
    unknown = tables.scan_agents(agents, None).collect()
    assert {r.ID for r in unknown} == {"2", "3"}


def test_config():
    assert [truthy(x) for x in (True, "Y", "1", 1, "true", "y", 0, None)] == [True] * 4 + [False] * 4
    assert ScanConfig.of(batch_size="9999").batch_size == 1000 and ScanConfig.of(entropy_threshold="4,5").entropy_threshold == 4.5
    assert ScanConfig.of(document_root="/s", exclude_paths="#DOCUMENT_ROOT#/a\n\n/b").exclude_paths == ("/s/a", "/b")
    for bad in ({"profile": "odd"}, {"nope": 1}):
        with pytest.raises(ConfigError):
            ScanConfig.of(**bad)
    with pytest.raises(ConfigError):
        ScanConfig.of(document_root="/s", scan_paths=["/t"]).confined()


@pytest.fixture
def site(tmp_path):
    root = tmp_path / "site"
    for name, text in {"upload/shell.php": "<?php echo 1;", ".htaccess": "AddHandler x-httpd-php .jpg", "a.php": "<?php eval($_POST['a']);", "b.png.php": "\x7fELF..", "cache/x.php": "<?php eval(1);", "cache-old/y.php": "<?php eval(1);", "n.txt": "x", "lib/z.js": "atob('x')"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def test_sitefiles_source_and_streams(spark, site, tmp_path):
    config = ScanConfig.of(document_root=str(site), scan_profile="deep", exclude_paths=[f"{site}/cache"], batch_size=2)
    df = sitefiles.read(spark, config, partitionBytes=5000)
    names = sorted(os.path.relpath(r.path, site) for r in df.select("path").collect())
    assert names == [".htaccess", "a.php", "cache-old/y.php", "lib/z.js", "n.txt", "upload/shell.php"]
    whole = {r.file_path: r.score for r in findings.scanned(df.select("path", "content"), config, code=True).collect()}
    run = ScanRun(spark, config, str(tmp_path / "work"))
    state = run.start()
    with pytest.raises(ConfigError, match="scan_already_running"):
        ScanRun(spark, config, str(tmp_path / "work")).start()
    steps = 0
    while state["status"] == "running":
        state, steps = run.step(), steps + 1
    assert steps >= 3 and {r.file_path: r.score for r in run.results().collect()} == whole
    streamed = scan_stream_once(spark, df.select("path", "content"), ScanConfig.of(document_root=str(site), scan_profile="deep"))
    plain = findings.scanned(df.select("path", "content"), ScanConfig.of(document_root=str(site), scan_profile="deep"))
    assert {(r.file_path, r.score) for r in streamed.collect()} == {(r.file_path, r.score) for r in plain.collect()}
    again = ScanRun(spark, config, str(tmp_path / "work2"))
    again.start()
    again.step()
    assert again.cancel()["status"] == "cancelled" and again.results().count() == 2 and again.report()["partial"]


def test_chunked_reading(site):
    big = site / "big.php"
    big.write_bytes(b"a" * 70_000)
    rows = list(sitefiles.read_rows(str(big), 70_000, 0.0, 1000))
    assert [len(r[4]) for r in rows] == [32_768, 33_280, 4_976] and [r[7] for r in rows] == [0, 32_256, 65_024]
    assert [r[10] for r in rows] == [None, None, hashlib.sha256(b"a" * 70_000).hexdigest()]


def test_stores_and_quarantine(site, tmp_path):
    rules = stores.Rules(str(tmp_path / "rules.json"))
    a = rules.add(type="signature", signature_id="php_eval")
    assert rules.add(type="signature", signature_id="php_eval")["id"] == a["id"] and len(rules.all()) == 1
    rules.set_active(a["id"], False)
    rules.delete(a["id"])
    assert rules.all() == []
    (tmp_path / "rules.json").write_text("{")
    with pytest.raises(stores.StoreError):
        rules.all()
    marks = stores.Suppressions(str(tmp_path / "s.json"))
    marks.add("f1")
    marks.add("f1")
    assert len(marks.all()) == 1
    (tmp_path / "s.json").write_text("{")
    assert marks.all() == []
    q = stores.Quarantine(str(tmp_path / "q"), str(site))
    item = q.take(str(site / "a.php"))
    assert not (site / "a.php").exists() and q.items()[0]["payload_exists"]
    assert q.restore(item["id"])["status"] == "restored" and (site / "a.php").exists()
    item = q.take(str(site / ".htaccess"))
    with pytest.raises(stores.StoreError, match="critical"):
        q.restore(item["id"])
    reports = stores.Reports(str(tmp_path / "r"))
    reports.save("one", {"found_total": 1}, {}, [{}])
    assert reports.list(5)[0]["scan_id"] == "one" and reports.load("one")["results"][0]["tags"] == []
    assert stores.allowed_feed_url("file:///x") and not stores.allowed_feed_url("http://a/b")


def test_cli_exit_codes(spark, site, tmp_path, capsys):
    assert cli.main(["scan", "--document-root", str(site)], spark) == 1
    assert cli.main(["scan", "--document-root", str(site / "lib"), "--no-urls", "--profile", "balanced", "--exclude", str(site / "lib")], spark) in (0, 3)
    assert cli.main(["scan", "--document-root", str(site), "--profile", "odd"], spark) == 2
    assert cli.main(["scan", "--bogus"], spark) == 2
    assert cli.main(["scan", "--document-root", str(site), "--action", "delete", "--execute"], spark) == 2
    assert cli.main(["scan", "--document-root", str(tmp_path / "none")], spark) == 3
    base = str(tmp_path / "base")
    assert cli.main(["baseline-create", "--document-root", str(site), "--baseline", base], spark) == 0
    assert cli.main(["baseline-check", "--document-root", str(site), "--baseline", base], spark) == 0
    (site / "new.php").write_text("<?php")
    assert cli.main(["baseline-check", "--document-root", str(site), "--baseline", base], spark) == 1


def test_cli_lists_and_actions(spark, site, tmp_path, capsys):
    import hashlib
    import json

    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
        return str(tmp_path / name)

    def run(*args):
        code = cli.main(["scan", "--document-root", str(site), *args], spark)
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    capsys.readouterr()
    code, plain = run("--action", "delete")  # dry
    assert code == 1 and (site / "a.php").exists()
    digest = hashlib.sha256((site / "lib/z.js").read_bytes()).hexdigest()
    known = put("hashes.json", {"items": [{"hash": digest, "name": "M"}]})
    agents = put("agents.json", '{"ID": "1", "MODULE_ID": "main", "NAME": "eval($_POST[1]);", "ACTIVE": "Y", "NEXT_EXEC": ""}')
    more = run("--hash-db", known, "--agents", agents)[1]
    assert more["findings_total"] > plain["findings_total"] + 1 and more["processed_total"] == plain["processed_total"]  # rows of tables are found, not processed
    warned = run("--hash-db", put("broken.json", "{"))[1]
    assert warned["found_total"] == plain["found_total"] and warned["informational_total"] > plain["informational_total"]
    rules = put("rules.json", {"rules": [{"id": "r", "type": "path_regex", "pattern": ".*", "active": True}]})
    doing = ("--action", "delete", "--execute", "--force", "--quarantine", str(tmp_path / "q"))
    assert run(*doing, "--whitelist", rules)[1]["applied"] == 0 and (site / "a.php").exists()
    got = run(*doing)[1]
    assert got["applied"] == got["found_total"] > 0 and not got["failed"] and not (site / "a.php").exists()
