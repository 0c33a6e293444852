"""The registered queries of this subpackage, with production parameters, and the SQL they are checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.catalog.common import Query, scratch
from tabloom.llm import alignment, chaining, licences, packing, positional_index, prefix_trie, pseudo_lm, quality, shingle_join, sparse_suffix, token_counts, token_files, toxicity
from tabloom.llm.common import benchmark, documents, labels, ship

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(documents(spark, sf_dir), BPE)
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_copies")


def op3_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(documents(spark, sf_dir), licences.known_licences(spark))
    return found.select("doc_id", "digest", "licence", F.array_join("notices", ",").alias("notices"), (F.col("licence").isNotNull() | (F.size("notices") > 0)).alias("licensed"))


def op4_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.contamination(documents(spark, sf_dir), benchmark(spark, sf_dir), size=10, slop=1)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    token_files.write_tokens(documents(spark, sf_dir), folder, BPE, end_id=0)
    return token_files.document_digests(spark, folder)


def op6_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chaining.repeats(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.col("start").alias("start_word"), (F.col("end") - F.col("start")).alias("n_words"), F.col("first_id").alias("first_doc_id"),
        F.col("first_start").alias("first_start_word"), (F.col("first_end") - F.col("first_start")).alias("first_n_words"), "matches",
    )


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir), BPE, end_id=2)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measure(documents(spark, sf_dir))
    judged = quality.judged(measured, quality.thresholds(measured, labels(spark, sf_dir)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.pseudo_likelihood(documents(spark, sf_dir))


def op10_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sparse_suffix.repeats(documents(spark, sf_dir))
    return found.select("doc_id", F.col("start").alias("start_word"), (F.col("end") - F.col("start")).alias("n_words"), F.col("other_id").alias("other_doc_id"), F.col("other_start").alias("other_start_word"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out())


def op11_weighted_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score_texts(docs, toxicity.learn(docs, training_labels(labels(spark, sf_dir))))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_words", "n_hits")


def op12_splitter_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    nodes = prefix_trie.trie(prefix_trie.rebuilt_paths(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return nodes.withColumn("ends_sha256", F.lower(F.hex("ends_digest"))).drop("ends_digest")


def op13_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), BPE, PIECES)


for query in (
    op1_token_counts, op2_lsh_forest, op3_licence_digests, op4_positional_index, op5_mixing_coder, op6_collinear_chains, op7_best_two_fit, op8_quality_rules, op9_masked_likelihood,
    op10_sparse_suffixes, op11_weighted_lexicon, op12_splitter_skeleton, op13_fragment_alignment,
):
    QUERIES[query.__name__] = query

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op4_positional_index"] = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[k:k + 9], ' ') AS win
 FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, size, k, array_to_string(ws[k:k + size - 1], ' ') AS win
 FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM w, sizes WHERE len(ws) >= size)),
hits AS (SELECT doc_id, item_id, k, p.size AS size FROM places p JOIN windows v ON p.win = v.win AND p.size = v.size),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM (SELECT DISTINCT doc_id, k, size FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

RULE_COUNTS = list(quality.RULES.values())
RISK = 0.04 / len(RULE_COUNTS)
LEVELS = ", ".join(f"CASE WHEN {under} > 0 THEN least({quality.STEPS}, ({over} * {quality.STEPS} + {under} - 1) // {under}) ELSE 0 END" for over, under in RULE_COUNTS)
SQL["op8_quality_rules"] = rf"""
WITH w AS (SELECT doc_id, lang, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, k, array_to_string(ws[k:k + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS k FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(regexp_replace(coalesce(text, ''), '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [{LEVELS}] AS levels FROM m),
good AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
hold AS (SELECT lang, good, unnest(range(1, {len(RULE_COUNTS) + 1})) AS rule, levels FROM f JOIN good USING (doc_id) WHERE NOT base_failed),
bars AS (SELECT lang, rule, cut, count(*) FILTER (good) AS n_good, count(*) FILTER (good AND levels[rule] > cut) AS k, count(*) FILTER (NOT good AND levels[rule] > cut) AS bad
  FROM hold, (SELECT unnest(range(0, {quality.STEPS})) AS cut) GROUP BY ALL),
tried AS (SELECT *, CASE WHEN k > n_good * {RISK} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({RISK}) + (n_good - i) * ln({1 - RISK})))) END AS p,
  (SELECT count(DISTINCT coalesce(lang, '')) FROM hold) AS strata FROM bars),
best AS (SELECT lang, rule, cut FROM tried WHERE n_good > 0 AND p <= 0.05 / (strata * {len(RULE_COUNTS) * quality.STEPS}) AND bad - 10 * k > 0
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY bad - 10 * k DESC, cut DESC) = 1),
broken AS (SELECT DISTINCT f.doc_id FROM f JOIN best ON f.lang IS NOT DISTINCT FROM best.lang AND f.levels[best.rule] > best.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept FROM f"""


def _canonical_sql(text: str) -> str:
    """The same steps in DuckDB's functions, where a group in a replacement is written with a backslash."""
    quoted = licences.TO_SIGNS.replace("'", "''")
    out = f"translate({text}, '{licences.FROM_SIGNS}', '{quoted}')"
    out = rf"regexp_replace({out}, '(?m)^[^a-z0-9\n]*(copyright( \(c\)|\s*©)?|\(c\)|©)[^\n]*[0-9]{{4}}[^\n]*$', ' ', 'g')"
    out = rf"regexp_replace({out}, '\ball rights reserved\b', ' ', 'g')"
    out = rf"regexp_replace({out}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')"
    for pattern, replacement in licences.SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
    return f"trim({out})"


SQL["op3_licence_digests"] = f"""
WITH known(licence, t) AS (VALUES {", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in licences.KNOWN)}),
table_k AS (SELECT DISTINCT licence, sha256({_canonical_sql("t")}) AS digest FROM known),
whole AS (SELECT doc_id, sha256({_canonical_sql("coalesce(text, '')")}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part FROM documents),
notice AS (SELECT DISTINCT doc_id, licence FROM (SELECT doc_id, sha256({_canonical_sql("part")}) AS digest FROM lines WHERE part <> '') JOIN table_k USING (digest)),
names AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS notices FROM notice GROUP BY doc_id)
SELECT whole.doc_id, digest, licence, coalesce(notices, '') AS notices, licence IS NOT NULL OR notices IS NOT NULL AS licensed
FROM whole LEFT JOIN table_k USING (digest) LEFT JOIN names ON whole.doc_id = names.doc_id"""
