import duckdb
import pytest

from palisade.llm import queries
from palisade.llm import quality_rules as Q

SF = "/root/testdata/sf0.001"


def test_current_policy_rejects_symbol_junk_and_repeated_lines(spark):
    words = [f"word{i}" for i in range(80)]
    clean = " ".join(words)
    junk = " ".join(f"{a} |" if i % 3 else a for i, a in enumerate(words))  # a ratio of 0.4
    lines = "\n".join([*(f"some line number {i} of a list" for i in range(8)), *["the same line again"] * 12])
    few = clean + " #tag & $5"
    rows = [(0, clean), (1, junk), (2, lines), (3, few), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    led = {x.doc_id: x for x in Q.ledger(df).withColumn("kept", Q.verdict()).withColumn("old", Q.verdict("v2")).collect()}
    assert {d: x.kept for d, x in led.items()} == {0: True, 1: False, 2: False, 3: True, 4: False}
    assert led[1].old and led[1].failure_bits == 1 << 7 and led[2].failure_bits & 1 << 4
    assert sorted(x.doc_id for x in Q.apply_rules(df).collect()) == [0, 3]
    alone = {x.rule: x.n_failed_alone for x in Q.ablation(Q.ledger(df)).collect()}
    assert alone["symbols_per_word"] == 1


@pytest.mark.parametrize("name", ["op5_quality_rules", "op5_quality_rules_v2"])
def test_ledgers_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
