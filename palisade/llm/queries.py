"""The registered queries ``opN_<name>`` of the corpus operators, with their DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import chat_format, decontamination, hard_negatives, jaccard_join, language_id, line_dedup, merkle, packing, quality_rules, sharding, token_counts, url_filter, warc
from palisade.llm.common import read_table, staged_path

SHARD_BYTES = 1 << 20


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in shards of at most 1 MiB of UTF-8 text, by extendible hashing of doc_id."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.assign_shards(docs, ["doc_id"], F.col("n_bytes"), SHARD_BYTES)


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
n AS (SELECT depth, h >> (60 - depth)::INT AS q, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs
      FROM d, (SELECT unnest(range(0, 41)) AS depth) GROUP BY ALL),
fit AS (SELECT * FROM n WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1),
best AS (SELECT doc_id, n_bytes, h, min(depth) AS depth FROM d, (SELECT unnest(range(0, 41)) AS depth) x
         WHERE EXISTS (SELECT 1 FROM fit WHERE fit.depth = x.depth AND fit.q = d.h >> (60 - x.depth)::INT) GROUP BY ALL)
SELECT best.doc_id, best.n_bytes, right(lpad(bin(fit.q), 60, '0'), best.depth::INT) AS shard, best.depth::INT AS shard_depth, fit.shard_bytes, fit.shard_docs
FROM best JOIN fit ON fit.depth = best.depth AND fit.q = best.h >> (60 - best.depth)::INT
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the items found in them."""
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


TOKEN_LIMIT = 1024


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of every whole document, with the prefix table that they come from."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts.with_counts(docs)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "prefix_deltas")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    parts = packing.pieces(read_table(spark, sf_dir, "documents"))
    return packing.packed(parts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: The rules and the policy of OP5_V2_SQL.
V2_BITS, V2 = 0b1111111, "v2"


def quality_rows(spark: SparkSession, sf_dir: str, policy: str, known: int) -> DataFrame:
    """The ledger of every whole document with a policy's verdict; ``known`` are the bits of its rules."""
    led = quality_rules.ledger(read_table(spark, sf_dir, "documents")).withColumn("failure_bits", F.col("failure_bits").bitwiseAND(F.lit(known).cast("long")))
    base = F.col("failure_bits").bitwiseAND(F.lit(quality_rules.POLICIES["base"]).cast("long")) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality_rules.verdict(policy).alias("kept"), "n_lines", "n_letters", "failure_bits")


def op5_quality_rules_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every whole document, with the verdict of the earlier policy v2 and the bits it knew."""
    return quality_rows(spark, sf_dir, V2, V2_BITS)


OP5_V2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS c FROM win),
cov AS (SELECT r, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, length(regexp_replace(text, '[^\p{L}]', '', 'g'))::BIGINT AS n_letters,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 40 * n_words) THEN 8 ELSE 0 END
        + CASE WHEN 2 * n_dup_lines > n_lines AND n_dup_lines >= 3 THEN 16 ELSE 0 END + CASE WHEN 3 * n_letters < word_chars THEN 32 ELSE 0 END
        + CASE WHEN n_words < 20 THEN 64 ELSE 0 END)::BIGINT AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & 3) <> 0 AS base_failed,
  (failure_bits & 47) = 0 AS kept, n_lines, n_letters, failure_bits FROM b
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every whole document with all bits and the verdict of the current policy, which the pipeline enforces too."""
    return quality_rows(spark, sf_dir, quality_rules.CURRENT, -1)


OP5_SQL = f"""
WITH v2 AS ({OP5_V2_SQL}),
x AS (SELECT *, failure_bits + CASE WHEN 10 * n_symbols > n_words THEN 128 ELSE 0 END AS bits FROM v2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (bits & 191) = 0 AS kept, n_lines, n_letters, bits AS failure_bits FROM x
"""

#: The conversation that op6 adds: control strings inside texts.
EXTRA_TEXT = r"\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, rows by turn, and conversation -7, a record of messages: two layouts that their
    fingerprints tell, formatted and read back."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = json.dumps({"messages": [{"role": role, "content": EXTRA_TEXT} for role in ("user", "assistant")]})
    record = chat_format.turns_from_records(spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(extra).alias("record")), "conv_id", "record")
    back = chat_format.parsed(chat_format.formatted(chat_format.turns_from_rows(rows).unionByName(record.drop("layout"))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA_TEXT}'),
e AS (SELECT *, length(text) + length(replace(text, '\', '')) * 0 + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '<', ''))) AS n FROM r),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss, sum(length(role) + n + 15)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    found = language_id.predicted(docs.select("doc_id", "text"), language_id.trained(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity group of every whole document, by five-word shingles at 0.75."""
    return jaccard_join.linked(read_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat an earlier one up to one edit."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs).select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(parts))) AS n, unnest(parts) AS line FROM d),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT line, min((doc_id, n)) AS place, length(line) AS len FROM w GROUP BY line),
h AS (SELECT line, place, len, m, left(line, m // 2) AS a, right(line, m - m // 2) AS b FROM f, (SELECT unnest([0, 1]) AS k), LATERAL (SELECT len - k AS m) WHERE len >= 20),
near AS (SELECT DISTINCT y.line FROM h x JOIN h y ON x.m = y.m AND x.a = y.a AND x.place < y.place WHERE abs(x.len - y.len) <= 1 AND levenshtein(x.line, y.line) <= 1
  UNION SELECT DISTINCT y.line FROM h x JOIN h y ON x.m = y.m AND x.b = y.b AND x.place < y.place WHERE abs(x.len - y.len) <= 1 AND levenshtein(x.line, y.line) <= 1),
kept AS (SELECT place.doc_id AS doc_id, place.n AS n FROM (SELECT {'doc_id': place[1], 'n': place[2]} AS place FROM f WHERE line NOT IN (SELECT line FROM near))),
o AS (SELECT l.doc_id, l.n, l.line, regexp_matches(l.line, '[^\x20\x09-\x0D]') AS wordy, kept.n IS NOT NULL AS k FROM l LEFT JOIN kept ON l.doc_id = kept.doc_id AND l.n = kept.n)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(CASE WHEN k OR NOT wordy THEN o.line END, chr(10) ORDER BY o.n), '') END AS text,
  count_if(wordy)::BIGINT AS n_lines, count_if(wordy AND NOT k)::BIGINT AS n_removed FROM d LEFT JOIN o ON d.doc_id = o.doc_id GROUP BY d.doc_id, d.text
"""


def op9_line_dedup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat an earlier one up to one character or one word."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs, words=True).select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


#: OP9_SQL with the lines within one word beside those within one character.
OP9_WORDS_SQL = OP9_SQL.replace("\nkept AS", r"""
wl AS (SELECT line, place, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM f WHERE len >= 20),
ww AS (SELECT line, place, w, array_to_string(w, ' ') AS v FROM wl WHERE len(w) >= 5),
wi AS (SELECT line, place, w, unnest(range(1, len(w) + 1)) AS i FROM ww),
wv AS (SELECT line, place, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v FROM wi),
wnear AS (SELECT line FROM (SELECT line, place, min(place) OVER (PARTITION BY i, v) AS earliest FROM wv) WHERE earliest < place
  UNION SELECT a.line FROM wv a JOIN ww b ON a.v = b.v WHERE b.place < a.place
  UNION SELECT b.line FROM wv a JOIN ww b ON a.v = b.v WHERE a.place < b.place),
kept AS""").replace("(SELECT line FROM near)", "(SELECT line FROM near UNION SELECT line FROM wnear)")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, written to the shared folder and read back by byte ranges."""
    folder = staged_path(spark, "warc")
    warc.write_archives(warc.marked(read_table(spark, sf_dir, "pages")), folder).agg(F.sum("records")).collect()
    return warc.read_archives(spark, folder, columns=("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper IS NOT NULL AND keeper IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to FROM d LEFT JOIN k USING (payload_digest, payload_bytes)
"""

MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in the manifest by language, and what it says of a copy in which some texts were lower-cased."""
    docs = read_table(spark, sf_dir, "documents").select(*MANIFEST_FIELDS)
    altered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    values = [F.col(c) for c in MANIFEST_FIELDS[:-1]]
    lowered = merkle.leaf_digest(*values, F.translate("text", url_filter.UPPER, url_filter.LOWER))
    made = merkle.manifest(docs, MANIFEST_FIELDS, "lang", ["doc_id"], {"doc_id": F.col("doc_id"), "altered": F.when(altered & F.col("text").isNotNull(), lowered)})
    rows = made.leaves.select(
        F.col("own.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", F.lit(made.root).cast("string").alias("root"), merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
        merkle.folded(F.coalesce("own.altered", "digest"), F.col("steps")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 over the digits of doc_id, from the table of its bytes; steps are texts with a bar where the digest from below goes.
OP11_SQL = r"""
WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
d AS (SELECT *, row_number() OVER () AS r, coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS tree,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS body,
    coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low,
    coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0, false) AS hit FROM documents, k),
l AS (SELECT r, doc_id, lang, tree, sha256(head || body) AS leaf, CASE WHEN hit THEN sha256(head || low) ELSE sha256(head || body) END AS other FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
up AS (SELECT tree, 0 AS lv, pos, n, leaf AS h FROM p
  UNION ALL SELECT tree, lv + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, lv + 1, pos // 8, (n + 7) // 8),
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY (SELECT min(lang) FROM p WHERE p.tree = up.tree) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lv, pos, n, subroot AS h FROM s
  UNION ALL SELECT lv + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lv + 1, pos // 8, (n + 7) // 8),
own AS (SELECT r, 0 AS top, u.lv, string_agg(CASE WHEN u.pos < p.pos // 8 ** u.lv THEN u.h WHEN u.pos > p.pos // 8 ** u.lv THEN u.h ELSE '|' END, '' ORDER BY u.pos) AS step
    FROM p JOIN up u ON u.tree = p.tree AND u.n > 1 AND u.pos // 8 = (p.pos // 8 ** u.lv) // 8 GROUP BY r, u.lv
  UNION ALL SELECT r, 1, u.lv, string_agg(CASE WHEN u.pos <> s.pos // 8 ** u.lv THEN u.h ELSE '|' END, '' ORDER BY u.pos)
    FROM p JOIN s USING (tree) JOIN top u ON u.n > 1 AND u.pos // 8 = (s.pos // 8 ** u.lv) // 8 GROUP BY r, u.lv),
proof AS (SELECT r, list(step ORDER BY top, lv) AS steps FROM own GROUP BY r),
f AS (SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(steps, []) AS steps, other FROM p JOIN s USING (tree) LEFT JOIN proof USING (r))
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256,
  list_reduce(list_prepend(other, steps), lambda a, x: sha256(replace(x, '|', a))) AS folded_root,
  list_reduce(list_prepend(other, steps), lambda a, x: sha256(replace(x, '|', a))) = root AS verified FROM f
""".replace("8 ** u.lv", "(8 ** u.lv)::BIGINT")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector, after some labels were moved on by one."""
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.select("vec_id", label.alias("label"), "embedding"))


OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score FROM e a, e c WHERE a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""

#: Longest first where two fit.
URL_RULES = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page's URL: its longest rule's, else the language models'."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, URL_RULES, url_filter.trained(pages, URL_RULES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_sharding": op1_sharding, "op2_decontamination": op2_decontamination, "op3_token_counts": op3_token_counts, "op4_packing": op4_packing, "op5_quality_rules": op5_quality_rules, "op5_quality_rules_v2": op5_quality_rules_v2, "op6_chat_format": op6_chat_format, "op7_language_id": op7_language_id, "op8_ngram_jaccard_join": op8_ngram_jaccard_join, "op9_line_dedup": op9_line_dedup, "op9_line_dedup_words": op9_line_dedup_words, "op10_warc": op10_warc, "op11_merkle_manifest": op11_merkle_manifest, "op12_hard_negatives": op12_hard_negatives, "op13_url_filter": op13_url_filter}
ORACLES: dict[str, str] = {"op1_sharding": OP1_SQL, "op5_quality_rules": OP5_SQL, "op5_quality_rules_v2": OP5_V2_SQL, "op6_chat_format": OP6_SQL, "op9_line_dedup": OP9_SQL, "op9_line_dedup_words": OP9_WORDS_SQL, "op10_warc": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op12_hard_negatives": OP12_SQL}
