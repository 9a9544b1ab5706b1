"""Whitelist rules and suppressions: findings set aside, and results summed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import ScanConfig, normal_path
from palisade.functions.paths import lowered
from palisade.operators.findings import fenced, summed
from palisade.operators.rules import java_pattern

#: A rule is a dict: id, type (path, path_regex, hash, signature, file_signature) and what it needs of path, pattern, hash, signature_id.
TYPES = ("path", "path_regex", "hash", "signature", "file_signature")


class RuleError(ValueError):
    pass


def checked(rule: dict) -> dict:
    """A usable rule, or an error code."""
    import re

    if rule.get("type") not in TYPES:
        raise RuleError("whitelist_type_invalid")
    if rule["type"] == "path_regex":
        try:
            re.compile(rule.get("pattern", ""))
        except re.error:
            raise RuleError("whitelist_pattern_invalid") from None
    need = {"path": ("path",), "path_regex": ("pattern",), "hash": ("hash",), "signature": ("signature_id",), "file_signature": ("signature_id",)}[rule["type"]]
    if any(not rule.get(k) for k in need) or rule["type"] == "file_signature" and not (rule.get("hash") or rule.get("path")):
        raise RuleError("whitelist_rule_incomplete")
    return rule


def condition(rule: dict, path: Column, file_hash: Column, signature: Column) -> Column:
    kind = rule["type"]
    same_path = F.rtrim(lowered(path), F.lit("/")) == normal_path(rule.get("path", "") or "\0")
    same_hash = F.coalesce(F.lower(file_hash) == (rule.get("hash") or "\0").lower(), F.lit(False))
    same_sig = F.lower(F.trim(signature)) == (rule.get("signature_id") or "\0").strip().lower()
    if kind == "path":
        return same_path
    if kind == "path_regex":
        return lowered(path).rlike(java_pattern(rule["pattern"], ""))
    if kind == "hash":
        return same_hash
    if kind == "signature":
        return same_sig
    return same_sig & (same_hash | same_path)


def matched_rule(rules: list[dict], path: Column, file_hash: Column, signature: Column) -> Column:
    """The id of the first rule that covers a finding, or null."""
    out = F.lit(None).cast("string")
    for rule in reversed([r for r in rules if r.get("active", True)]):
        out = F.when(condition(rule, path, file_hash, signature), rule["id"]).otherwise(out)
    return out


def whitelisted(results: DataFrame, rules: list[dict], config: ScanConfig = ScanConfig()) -> DataFrame:
    """``results`` with kept findings, ``ignored`` (struct of finding and rule id) and sums anew; tags never shrink."""
    with_rule = F.transform("findings", lambda f: F.struct(f.alias("finding"), matched_rule(rules, F.col("file_path"), F.col("file_hash"), f["signature_id"]).alias("rule_id")))
    df = fenced(results.withColumn("__tags", F.col("tags")), __all=with_rule)
    ignored = F.filter("__all", lambda x: x["rule_id"].isNotNull())
    return _again(fenced(df, ignored=ignored, findings=F.transform(F.filter("__all", lambda x: x["rule_id"].isNull()), lambda x: x["finding"])), config)


#: Suppressed fingerprints that are tested within a row; longer lists are joined.
IN_ROW = 1000


def suppressed(results: DataFrame, fingerprints: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Findings whose fingerprint is in ``fingerprints(fingerprint)`` are set aside. A list of at most :data:`IN_ROW`
    goes to every row; a longer one meets the exploded fingerprints in an equi-join."""
    marks = fingerprints.select("fingerprint").where("fingerprint IS NOT NULL").distinct()
    few = marks.limit(IN_ROW + 1).collect()
    if len(few) <= IN_ROW:
        gone = F.array(*[F.lit(r["fingerprint"]) for r in few]).cast("array<string>")
        df = results.withColumn("__gone", gone)
    else:
        own = results.select("file_path", F.explode(F.transform("findings", lambda f: f["fingerprint"])).alias("fingerprint")).distinct()
        hit = own.join(marks, "fingerprint", "left_semi").groupBy("file_path").agg(F.collect_set("fingerprint").alias("__gone"))
        df = results.join(hit, "file_path", "left").withColumn("__gone", F.coalesce("__gone", F.array().cast("array<string>")))
    hit = lambda f: F.array_contains("__gone", f["fingerprint"])
    df = fenced(df.withColumn("__tags", F.col("tags")), ignored=F.filter("findings", hit), findings=F.filter("findings", lambda f: ~hit(f)))
    return _again(df.drop("__gone"), config)


def _again(df: DataFrame, config: ScanConfig) -> DataFrame:
    out = summed(df, config, "__tags").drop("__tags", "__all")
    return out


def planned_action(status: Column, has_risk: Column, action: str, dry_run: bool) -> tuple[Column, Column]:
    """(action, planned_action) of a result: nothing without a finding of risk, dry runs only say what they would do."""
    none = F.lit(None).cast("string")
    if action == "report":
        return F.when(has_risk, "reported").otherwise(none), none
    if action not in ("quarantine", "delete"):
        return F.when(has_risk, "unsupported").otherwise(none), F.when(has_risk, action).otherwise(none)
    done = "dry_run" if dry_run else "pending"
    return F.when(has_risk, done).otherwise(none), F.when(has_risk, action).otherwise(none)
