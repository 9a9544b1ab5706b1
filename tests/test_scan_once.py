"""A scan reads a file's content once, however many analyzers ask for it."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def times_cleaned(df):
    """How often the optimized plan cleans a text: each is a pass over the whole of it."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(text")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name, scans", [("binary_sniff", 1), ("normalized_duplicates", 1), ("prefilter_any", 1), ("entropy_values", 1), ("rule_php_shell_exec", 1), ("report_rows", 1), ("report_sort_signature", 1), ("hash_db_match", 2), ("baseline_summary", 2), ("baseline_root_findings", 2)])
def test_contents_are_computed_once(spark, name, scans):
    from palisade.plans.queries import QUERIES

    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000000")
    try:
        assert times_cleaned(rewritten(QUERIES[name](spark, SF))) == scans
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


def rewritten(df):
    assert df.count() >= 0
    return df


def test_clean_drops_what_the_negated_class_drops(spark):
    from palisade.plans.overlay import CLEAN

    points = [chr(i) for i in [*range(0x3000), *range(0xD700, 0xD800), *range(0xE000, 0x10FFFF, 97), 0x10FFFF]]
    df = spark.createDataFrame([(c,) for c in points], "c string")
    assert df.where(F.regexp_replace(F.concat(F.lit("a"), "c", "c"), CLEAN, "") != F.regexp_replace(F.concat(F.lit("a"), "c", "c"), "[^A-Za-z \\n.,]", "")).count() == 0


def test_hex_runs_are_found_beside_longer_ones(spark):
    from palisade.operators.entropy import candidates

    run, hexes = "Zz" * 120, "0a" * 110
    rows = [(1, hexes), (2, f"{run} {hexes}"), (3, f"{hexes} {hexes}"), (4, "plain")]
    got = {r["i"]: [(c["value"], c["offset"]) for c in r["c"]] for r in spark.createDataFrame(rows, "i int, t string").select("i", candidates(F.col("t"), 200).alias("c")).collect()}
    assert got == {1: [(hexes, 0), (hexes, 0)], 2: [(hexes, 241)], 3: [], 4: []}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_suppression_scans_the_site_once(spark):
    from palisade.plans.queries import suppress_eval

    plan = suppress_eval(spark, SF)._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan
    spark.catalog.clearCache()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_full_scan_reads_the_site_once_for_its_analyzers(spark):
    from palisade.plans.queries import QUERIES

    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000000")
    try:  # the analyzers, the domains of the files' URLs, the list of hashes
        assert times_cleaned(QUERIES["full_scan"](spark, SF)) == 3
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_report_page_is_one_scan(spark):
    from palisade.plans.queries import QUERIES

    spark.sparkContext.setJobGroup("report_page", "")
    QUERIES["report_page"](spark, SF)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("report_page")
    spark.sparkContext.setJobGroup("other", "")
    assert len(jobs) <= 1  # the schema of the table


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_links_are_read_from_their_files(spark):
    from palisade.plans.queries import QUERIES

    assert QUERIES["link_urls"](spark, SF).count() > 0


def test_classes_name_their_members(spark):
    import re

    from palisade.operators.rules import java_pattern

    for pattern in ("[A-Za-z0-9_]+", "[^a-f-]+", "[]a-c]+", "[+-9x-z]+", "a-z", "[a\\-z]+", "[^]b-d]", "[W-b]+"):
        made = java_pattern(pattern, "")
        points = [chr(i) for i in range(1, 128)]
        df = spark.createDataFrame([(c,) for c in points + ["a-z"]], "c string")
        got = {r.c for r in df.where(F.col("c").rlike(f"^(?:{made})$")).collect()}
        assert got == {c for c in points + ["a-z"] if re.fullmatch(pattern, c)}, pattern
    assert java_pattern("[A-Ca-c0-2]", "") == "[ABCabc012]" and java_pattern("x[^b-d]", "i") == "(?i)x[^bcd]"


def test_a_stream_of_many_files_takes_few_batches(spark, tmp_path, monkeypatch):
    from palisade.streaming import scan

    monkeypatch.setattr(scan, "shared_folder", lambda _: f"file://{tmp_path}/run")
    files = spark.range(0, 20, 1, 20).select(F.concat(F.lit("/s/"), "id", F.lit(".php")).alias("path"), F.lit("<?php eval($a);").alias("content"))
    assert scan.scan_stream_once(spark, files).where("score = 5").count() == 20
    assert len([p for p in os.listdir(tmp_path / "run/out") if p.startswith("batch=")]) == -(-20 // (4 * spark.sparkContext.defaultParallelism))
