import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["rule_findings", "file_verdict_balanced", "domain_match", "baseline_diff", "suppression_antijoin", "agent_heuristics", "event_risks", "result_tags"])
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "documents events benchmark pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*cols).collect()), key=repr)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows == sorted(want, key=repr)
