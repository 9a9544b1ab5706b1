"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once for a document; the ledger row holds the measurements and a
``failure_bits`` integer with bit b set if rule b failed. A policy is a version name with a mask of
the rules that it enforces. Applying another policy, or asking what a policy would keep without one
of its rules, reads the ledger's bits and no text.

Defined cases: a null text counts as the empty one (no words, so the base rules fail). Empty tables
give empty ledgers. Repeated rows each get their own ledger row. Columns other than the id and the
text are ignored by :func:`ledger` and carried by :func:`apply_rules`; internal names start with
``__q_``, so clashing names such as ``words`` do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import WORD, text_or_empty

#: Bits that a window's position takes in its sort key; longer texts skip the first pass.
POSITION_BITS = 21


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    #: SQL over the measurements; true if the document fails.
    fails: str


#: Fixed order: a rule keeps its bit for ever, so that old ledgers stay readable.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_heavy", "n_symbols > n_words"),
    Rule(3, "mean_word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 40 * n_words)"),
    Rule(4, "duplicate_lines", "2 * n_dup_lines > n_lines AND n_dup_lines >= 3"),
    Rule(5, "few_letters", "3 * n_letters < word_chars"),
    Rule(6, "short_document", "n_words < 20"),
    Rule(7, "symbols_per_word", "10 * n_symbols > n_words"),
)
#: Version name to the bits that it enforces.
POLICIES = {"base": 0b0000011, "v1": 0b0001111, "v2": 0b0101111, "v3": 0b10111111, "observe": 0}
CURRENT = "v3"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_letters", "n_repeat_words")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measurements of :data:`MEASURES` (long), each text read whole and once.

    Repeated three-word windows are found inside the row: the windows' hashes, with positions in
    the low bits, are sorted as plain longs; windows whose hash has an equal neighbour are
    candidates, and those are compared as strings. No row leaves its partition.
    """
    space = F.lit(" ")
    at = lambda a, i: F.get(F.col(a), i)
    t = F.col("__q_text")
    df = df.withColumn("__q_text", text_or_empty(text)).withColumn("__q_w", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    n = F.size("__q_w")
    low = F.lit((1 << POSITION_BITS) - 1).cast("long")
    window = lambda i: F.concat_ws(" ", at("__q_w", i), at("__q_w", i + 1), at("__q_w", i + 2))
    df = df.withColumn(
        "__q_key",
        F.sort_array(
            F.transform(
                F.slice("__q_w", F.lit(1), F.greatest(n - 2, F.lit(0))),
                lambda w, i: F.xxhash64(w, at("__q_w", i + 1), at("__q_w", i + 2)).bitwiseAND(F.lit(-1 << POSITION_BITS).cast("long")).bitwiseOR(i.cast("long")),
            )
        ),
    )
    head = lambda k: F.shiftright(k, POSITION_BITS)
    df = df.withColumn(
        "__q_cand",
        F.when(
            n <= (1 << POSITION_BITS),
            F.transform(
                F.filter("__q_key", lambda k, i: F.coalesce(head(k) == head(at("__q_key", i + 1)), F.lit(False)) | F.coalesce(head(k) == head(at("__q_key", i - 1)), F.lit(False))),
                lambda k: k.bitwiseAND(low).cast("int"),
            ),
        ).otherwise(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))),
    )
    df = df.withColumn("__q_pair", F.array_sort(F.transform("__q_cand", lambda i: F.struct(window(i).alias("w"), i.alias("i")))))
    same = lambda p, i: F.coalesce(p["w"] == at("__q_pair", i)["w"], F.lit(False))
    df = df.withColumn("__q_pos", F.sort_array(F.transform(F.filter("__q_pair", lambda p, i: same(p, i + 1) | same(p, i - 1)), lambda p: p["i"])))
    covered = F.aggregate(
        F.transform("__q_pos", lambda p, i: F.least(F.lit(3), F.coalesce(at("__q_pos", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("__q_lines", lines)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    values: dict[str, Column] = {
        "n_words": n,
        "word_chars": F.length(t) - count("[\\x20\\x09-\\x0D]"),
        "n_symbols": count("[#*$%&|<>]"),
        "n_lines": F.size("__q_lines"),
        "n_dup_lines": F.size("__q_lines") - F.size(F.array_distinct("__q_lines")),
        "n_letters": F.length(t) - count("[^\\p{L}]"),
        "n_repeat_words": covered,
    }
    # a generator of one row: filters on the measurements stay above it, where they would else copy them
    row = F.struct(*[v.cast("long").alias(k) for k, v in values.items()])
    own = [c for c in df.columns if not c.startswith("__q_") and c not in values]
    return df.select(*own, F.explode(F.array(row)).alias("__q_m")).select(*own, "__q_m.*")


def failure_bits() -> Column:
    """One bit for each rule, from the measurements."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: id, measurements, ``failure_bits``."""
    return measured(df.select(F.col(id_col), F.col(text).alias("__text")), "__text").drop("__text").withColumn("failure_bits", failure_bits())


def verdict(policy: str = CURRENT, bits: str = "failure_bits") -> Column:
    """True if no enforced rule failed."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def apply_rules(df: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the policy keeps, with ``df``'s own columns."""
    own = df.select(F.struct("*").alias("__own"), F.col(text).alias("__text"))
    judged = measured(own, "__text").withColumn("__bits", failure_bits())
    return judged.where(verdict(policy, "__bits")).select("__own.*")


def ablation(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A row for each enforced rule: documents failing it, failing it alone (kept if the rule were
    dropped), and kept by the policy and without the rule. One pass of bitwise aggregates."""
    mask = POLICIES[policy]
    bits = F.col("failure_bits").bitwiseAND(F.lit(mask).cast("long"))
    enforced = [r for r in RULES if mask >> r.bit & 1]
    sums = [F.count_if(F.col("b").bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias(f"f{r.bit}") for r in enforced]
    alone = [F.count_if(F.col("b") == (1 << r.bit)).alias(f"a{r.bit}") for r in enforced]
    one = led.select(bits.alias("b")).agg(F.count_if(F.col("b") == 0).alias("kept"), *sums, *alone)
    rows = [F.struct(F.lit(policy).alias("policy"), F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"a{r.bit}").alias("n_failed_alone"), F.col("kept").alias("n_kept"), (F.col("kept") + F.col(f"a{r.bit}")).alias("n_kept_without")) for r in enforced]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*") if rows else led.sparkSession.createDataFrame([], "policy string, rule string, n_failed long, n_failed_alone long, n_kept long, n_kept_without long")
