"""The finding record and the helpers that build it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = {
    "signature_id": "string", "name": "string", "category": "string", "severity": "string", "score": "int", "offset": "long", "excerpt": "string", "target": "string", "rule_type": "string",
    "trace": "string", "file": "string", "line": "int", "type": "string", "source": "string", "fingerprint": "string", "confidence": "string", "entropy": "double", "length": "int",
    "url": "string", "domain": "string", "hash": "string", "hash_algorithm": "string", "recommendation": "string", "tags": "array<string>",
}
DEFAULTS = {"category": "generic", "severity": "low", "score": 1, "target": "content", "rule_type": "regex"}
FINDING = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"
FINDINGS = f"array<{FINDING}>"
#: Unknown severities weigh 0 and never displace another.
SEVERITIES = ("info", "low", "medium", "high", "critical")


def as_column(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def sql_literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "NULL" if v is None else str(v)


def finding(signature_id, **values) -> Column:
    """A finding struct; fields not given take their defaults, or null. What is fixed is one SQL text, since a plan holds many findings
    and each part of a column is a call to the JVM."""
    got = {"signature_id": signature_id, "name": signature_id} | DEFAULTS | values
    fixed = {k: None if isinstance(v, Column) else v for k, v in got.items()}
    out = F.expr("named_struct(" + ", ".join(f"'{k}', cast({sql_literal(fixed.get(k))} as {t})" for k, t in FIELDS.items()) + ")")
    moving = {k: v.cast(FIELDS[k]) for k, v in got.items() if isinstance(v, Column)}
    return with_values(out, moving)


def with_values(struct: Column, values: dict[str, Column]) -> Column:
    for k, v in values.items():
        struct = struct.withField(k, v)
    return struct


def no_findings() -> Column:
    return F.array().cast(FINDINGS)


def some(*findings: Column) -> Column:
    """The findings that are not null, in order."""
    return F.filter(F.array(*findings), lambda f: f.isNotNull()).cast(FINDINGS) if findings else no_findings()


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def weight(severity: Column) -> Column:
    out = F.lit(0)
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def severity_of(w: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), w.cast("int") + 1)
