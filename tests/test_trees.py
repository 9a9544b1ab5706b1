"""The tree source as a partitioned stream, stepwise sessions, and chunked files as one result."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from palisade.config import ConfigError, ScanConfig
from palisade.operators import findings, hashdb, trees
from palisade.sources import sitefiles
from palisade.streaming.scan import ScanRun

FILES = {"upload/shell.php": "<?php echo 1;", ".htaccess": "AddHandler x-httpd-php .jpg", "a.php": "<?php eval($_POST['a']);", "b.png.php": "\x7fELF..", "cache/x.php": "<?php eval(1);", "cache-old/y.php": "<?php eval(1);", "n.txt": "x", "lib/z.js": "atob('x')", "lib/deep/er/q.php": "<?php 1;", "é.php": "<?php é"}


@pytest.fixture
def site(tmp_path):
    root = tmp_path / "site"
    for name, text in FILES.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def config_for(site, **more):
    return ScanConfig.of(document_root=str(site), scan_profile="deep", exclude_paths=[f"{site}/cache"], **more)


def visited(config):
    front, out = sitefiles.Frontier(config), []
    while front.next_node() is not None:
        out.append((front.root, front.at))
    return out


def test_frontier_goes_on_from_any_place(site, tmp_path):
    os.symlink(site / "lib", site / "link")
    config = config_for(site, scan_paths=[str(site / "lib"), str(site), str(site / "upload"), str(site / "link/deep")])
    whole = visited(config)
    assert len({p for _, p in whole if os.path.isfile(p)}) == len([p for _, p in whole if os.path.isfile(p)])
    for i, (root, at) in enumerate(whole):
        front, rest = sitefiles.Frontier(config, root, at), []
        while front.next_node() is not None:
            rest.append((front.root, front.at))
        assert rest == whole[i + 1 :], at
    names = [os.path.relpath(p, site) for p, _, _ in sitefiles.walk(config)]
    # by root, depth first, names by bytes; nothing twice; the linked folder only as a root of its own
    assert names == ["lib/deep/er/q.php", "lib/z.js", ".htaccess", "a.php", "b.png.php", "cache-old/y.php", "n.txt", "upload/shell.php", "é.php", "link/deep/er/q.php"]


def test_frontier_survives_deleted_files(site):
    config = config_for(site)
    whole = visited(config)
    at = next(i for i, x in enumerate(whole) if x[1].endswith("lib/deep/er/q.php"))
    import shutil

    shutil.rmtree(site / "lib/deep")
    front = sitefiles.Frontier(config, *whole[at])
    assert front.next_node() == whole[at + 1][1]


def test_stream_gives_each_file_once_over_restarts(spark, site, tmp_path):
    for i in range(30):
        (site / f"lib/f{i}.js").write_text("x")
    config = config_for(site, batch_size=7)
    got, batches = [], []

    def keep(df, n):
        rows = df.select("path", "content", "sha256").collect()
        batches.append(len(rows))
        got.extend(rows)

    def run():
        q = sitefiles.read_stream(spark, config, partitionBytes=5000).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    first = run()  # one bounded step each time; another reader, told by the checkpoint where it stands
    assert batches == [7] or batches == [6]
    assert json.loads(first.recentProgress[-1].json)["sources"][0]["endOffset"]["files"] == 7
    for _ in range(12):
        run()
    batch = sitefiles.read(spark, config).select("path", "content", "sha256").collect()
    assert sorted(got) == sorted(batch) and max(batches) <= 7
    assert {r.sha256 for r in batch} == {hashlib.sha256(open(r.path, "rb").read()).hexdigest() for r in batch}
    assert not [r for r in batch if r.path.endswith("b.png.php")]


def test_step_is_bounded_in_nodes(site):
    for i in range(600):
        (site / f"lib/{i}.nothing").write_text("x")
    reader = sitefiles.StreamReader({"config": json.dumps(config_for(site, batch_size=1).to_dict())})
    last, steps = reader.initialOffset(), 0
    while (end := reader.latestOffset()) != last:
        assert end["nodes"] - last["nodes"] <= sitefiles.LEAST_NODES and end["files"] - last["files"] <= 1
        last, steps = end, steps + 1
    assert last["files"] == len(list(sitefiles.walk(config_for(site)))) and steps > 3


def test_roots_that_cannot_be_scanned(tmp_path):
    os.mkfifo(tmp_path / "pipe")
    with pytest.raises(ConfigError, match="scan_path_not_regular_file_or_directory"):
        sitefiles.present_roots(ScanConfig.of(document_root=str(tmp_path), scan_paths=[str(tmp_path / "pipe")]))


def test_session_resumes_cancels_and_counts_tables(spark, site, tmp_path):
    config = config_for(site, batch_size=4)
    agents = spark.createDataFrame([("1", "main", "eval($_POST[1]);", "Y")], "ID string, MODULE_ID string, NAME string, ACTIVE string")
    work = str(tmp_path / "work")
    with pytest.raises(ConfigError, match="scan_session_not_found"):
        ScanRun(spark, config, work).status()
    one = ScanRun(spark, config, work, agents=agents)
    one.start()
    one.step()
    state = ScanRun(spark, config, work, agents=agents).resume_to_completion()  # another object, as after a crash
    whole = {r.file_path: r.score for r in trees.tree_scanned(sitefiles.read(spark, config), config, code=True).collect()}
    rows = one.results().collect()
    assert {r.file_path: r.score for r in rows if r.origin == "file"} == whole and len(rows) == len(whole) + 1
    assert state["status"] == "finished" and state["processed_total"] == len(whole)
    assert state["found_total"] == sum(s > 0 for s in whole.values()) + 1 and not one.report()["partial"]
    two = ScanRun(spark, config, work, agents=agents)
    two.start()  # the marker of the finished run is gone
    with pytest.raises(ConfigError, match="scan_already_running"):
        ScanRun(spark, config, work).start()
    two.step()
    state = two.cancel()
    report = two.report()
    assert state["status"] == "cancelled" == two.step()["status"] and report["partial"] and report["summary"]["processed_total"] == two.results().count() > 0
    assert two.results().where("origin = 'db'").count() == 0
    (tmp_path / "work" / "active.json").write_text('{"scan_id": "gone"}')  # stale: its session does not exist
    assert ScanRun(spark, config, work).start()["status"] == "running"


def big_text():
    """Two MB with rule hits inside chunks, on their edges and in the overlaps, and one URL."""
    filler = ("line of plain text without anything to see here\n" * 50_000)[:2_100_000]
    out = list(filler)

    def put(at, s):
        out[at : at + len(s)] = s

    edge = 32_768
    put(5 * edge - 4, " eval ($x);")  # over the end of a chunk's own part
    put(9 * edge - 300, " base64_decode('a')")
    put(20 * edge + 77, " eval ($later);")
    put(30 * edge, " system($_GET['cmd']);")
    put(40 * edge - 512 + 3, " gzinflate(")
    put(50 * edge - 8, "<iframe src='http://a.bad.example.org/x'></iframe>\n")
    put(60 * edge, " base64_decode('again')")
    return "<?php " + "".join(out)


def test_chunked_file_equals_whole_file_scan(spark, site):
    (site / "big.php").write_text(big_text())
    (site / "upload/big2.php").write_text("<?php\n" + "y\n" * 700_000)
    lists = spark.createDataFrame([(0, "example.org", "critical", ["phish"])], "ord int, domain string, severity string, tags array<string>")
    small = config_for(site, max_file_mb=1, ast=False)
    digest = hashlib.sha256((site / "big.php").read_bytes()).hexdigest()
    items = spark.createDataFrame([(0, digest, "M", ["t"])], "ord long, hash string, name string, tags array<string>")
    known = hashdb.Known(hashdb.database(items), None, ("broken",), str(site / ".htaccess"))
    rows = sitefiles.read(spark, small)
    assert rows.where("chunked").groupBy("path").count().count() == 2
    got = {r.file_path: r for r in trees.tree_scanned(rows, small, known=known, domains=lists).collect()}
    whole = config_for(site, max_file_mb=100, ast=False)
    want = {r.file_path: r for r in trees.tree_scanned(sitefiles.read(spark, whole), whole, known=known, domains=lists).collect()}
    assert set(got) == set(want) and len(got) == rows.select("path").distinct().count()
    for path in want:
        g, w = got[path], want[path]
        assert (g.file_hash, g.score, g.severity, g.status, g.tags) == (w.file_hash, w.score, w.severity, w.status, w.tags), path
        assert g.findings == w.findings, path
    big = got[str(site / "big.php")]
    assert big.file_hash == digest and {"known_malware_hash_match", "php_eval", "external_url_detected", "suspicious_domain_match"} <= {f.signature_id for f in big.findings}
    assert next(f for f in big.findings if f.signature_id == "php_eval").offset == 5 * 32_768 - 4 + 6 + 1
    warned = [p for p, r in got.items() if any(f.signature_id == "hash_db_runtime_warning" for f in r.findings)]
    assert warned == [str(site / ".htaccess")]


def test_unreadable_file_is_an_error_result(spark, site):
    config = config_for(site)
    lost = spark.createDataFrame(list(sitefiles.read_rows(str(site / "none.php"), 10, 0.0, 1000)) + list(sitefiles.read_rows(str(site / "big.php"), 9999, 0.0, 10)), sitefiles.SCHEMA)
    got = {os.path.basename(r.file_path): r for r in trees.tree_scanned(lost, config).collect()}
    assert [(r.status, r.score, r.findings, r.error) for r in (got["none.php"], got["big.php"])] == [("error", 0, [], "file_read_failed"), ("error", 0, [], "large_file_open_failed")]


def test_empty_chunk_table(spark, site):
    none = sitefiles.read(spark, config_for(site)).limit(0)
    assert trees.tree_scanned(none, config_for(site)).count() == 0


def test_dedupe_keeps_first_places_and_stays_linear(spark):
    from palisade.schema import FINDINGS

    def f(i, sig, offset, excerpt):
        return {"signature_id": sig, "offset": offset, "excerpt": excerpt, "target": "content", "rule_type": "regex", "line": i}

    made = [f(0, "b", 1, "x"), f(1, "a", 1, "x"), f(2, "b", 1, "x"), f(3, "", 1, "x"), f(4, "", 1, "x"), f(5, "p", None, ""), f(6, "p", None, ""), f(7, "p", None, "z"), f(8, "b", 2, "x"), f(9, "a", 1, "x")]
    df = spark.createDataFrame([(made,), ([],), (None,)], f"findings {FINDINGS}")
    kept = [[x.line for x in r[0]] if r[0] is not None else None for r in df.select(findings.deduped(F.col("findings"))).collect()]
    assert kept == [[0, 1, 3, 4, 5, 7, 8], [], None]
    import time

    def seconds(n):
        many = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.from_json(F.concat(F.lit('{"signature_id":"s","excerpt":"'), (i % (n // 2)).cast("string"), F.lit('"}')), FINDINGS[6:-1])).alias("findings")).cache()
        began = time.time()
        assert many.select(F.size(findings.deduped(F.col("findings")))).first()[0] == n // 2
        return time.time() - began

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4000), 0.5)
