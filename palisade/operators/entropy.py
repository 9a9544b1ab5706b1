"""High-entropy payloads: candidates that occur exactly once by pattern, with their surroundings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.hashes import shannon
from palisade.operators.rules import java_pattern
from palisade.schema import FINDINGS, finding

# Words that make a payload's surroundings dangerous.
MARKERS = "eval assert base64_decode gzinflate gzuncompress str_rot13 create_function atob fromCharCode Function(".split()


def candidates(content: Column, least: int) -> Column:
    """array<struct<value, offset>>: base64-like run, hex run, quoted string; each only if it matches once. A hex run
    lies in a base64-like one, so both are sought only where there is one, and quoted strings only where there is a quote."""
    run, hexes, quoted = java_pattern(f"[A-Za-z0-9+/=]{{{least},}}", ""), java_pattern(f"\\b[0-9a-fA-F]{{{least},}}\\b", ""), f"(?s)([\"'])(.{{{least},}}?)\\1"

    def once(pattern, group):
        value = F.regexp_extract(content, pattern, group)
        at = F.regexp_instr(content, F.lit(pattern)) - 1 + (1 if group else 0)
        return F.when(F.regexp_count(content, F.lit(pattern)) == 1, F.struct(value.alias("value"), at.alias("offset")))

    none = F.array().cast("array<struct<value:string,offset:int>>")
    runs = F.when(content.rlike(run), F.array(once(run, 0), once(hexes, 0))).otherwise(none)
    quotes = F.when(content.contains('"') | content.contains("'"), F.array(once(quoted, 2))).otherwise(none)
    return F.filter(F.concat(runs, quotes), lambda c: c.isNotNull())


def excerpt(value: Column) -> Column:
    v = F.regexp_replace(value, "\\s+", " ")
    return F.when(F.length(v) <= 160, v).otherwise(F.concat(F.substr(v, F.lit(1), F.lit(120)), F.lit("..."), F.substr(v, F.length(v) - 31)))


def entropy_findings(path: Column, content: Column, least: int = 200, threshold: float = 4.7, window: int = 300) -> Column:
    measured = F.transform(candidates(content, least), lambda c: F.struct(c["value"].alias("value"), c["offset"].alias("offset"), shannon(c["value"]).alias("bits")))

    def judge(c):
        v, at = c["value"], c["offset"]
        start = F.greatest(at - window, F.lit(0))
        around = F.lower(F.substr(content, start + 1, at - start + F.length(v) + window))
        danger = F.lit(False)
        for m in MARKERS:
            danger = danger | around.contains(m.lower())
        encoded = (v.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(v) % 4 == 0)) | v.rlike("^(?:[0-9a-fA-F]{2})+$")
        pick = lambda a, b: F.when(danger, a).otherwise(b)
        made = finding(
            "entropy_high_encoded_payload", name="High entropy encoded payload", category="entropy", severity=pick("high", "medium"), confidence=pick("medium", "low"), score=pick(7, 5), offset=at, excerpt=excerpt(v),
            rule_type="entropy", file=path, type="encoded_payload", source=pick("high_entropy_with_dangerous_marker", "high_entropy_string"), entropy=F.round(c["bits"], 4), length=F.length(v),
            tags=F.array(*map(F.lit, ["engine:entropy", "risk:entropy", "risk:encoded_payload"])),
        )
        keep = (F.length(v) >= least) & (c["bits"] >= threshold) & (danger | encoded)
        return F.struct(F.concat_ws(":", at, F.sha1(F.substr(v, F.lit(1), F.lit(512)))).alias("key"), F.when(keep, made).alias("f"))

    found = F.filter(F.transform(measured, judge), lambda x: x["f"].isNotNull())
    keys = F.transform(found, lambda x: x["key"])
    first = F.filter(found, lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    return F.transform(first, lambda x: x["f"]).cast(FINDINGS)
