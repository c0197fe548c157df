"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer(), capacity=2048)


def op7_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import linked_vectors

    return linked_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op8_sstable_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sstable import read_shards, write_shards

    return read_shards(spark, write_shards(_table(spark, sf_dir, "documents"), _tokenizer()))


def op1_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored

    return scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import decide

    found = decide(_table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_components

    return similar_components(_table(spark, sf_dir, "documents"), k=3, threshold=(90, 100))


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import scored

    return scored(_table(spark, sf_dir, "documents"))


def op6_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identified

    return identified(_table(spark, sf_dir, "documents"))


def op9_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compared

    return compared(_table(spark, sf_dir, "documents"))


#: Verdict, host and path of each rule of op10.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op10_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judge

    return judge(_table(spark, sf_dir, "pages"), RULES)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(_table(spark, sf_dir, "documents"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentence_pieces import decode, encode

    model = public_tokenizers.path("piece_bpe_32k.model")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    found = decode(encode(_table(spark, sf_dir, "documents"), model).select("doc_id", "ids"), model)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity_ftrl, op2_best_fit_packing, op3_pareto_mixing, op4_ngram_jaccard, op5_context_mixing, op6_language_gru, op7_pivot_permutation, op8_sstable_output, op9_closed_syncmers, op10_link_trust, op11_source_divergence, op12_spelling_variants, op13_sentence_pieces)}

ORACLES: dict[str, str] = {
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (
  SELECT g.lang, g.source, k.term, k.n AS in_lang, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sized AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source) AS BIGINT) AS whole, CAST(sum(in_lang) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source) AS BIGINT) AS lang_whole
  FROM cells),
weighed AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 1) // whole AS p, 1 + 1000000000 * (in_lang + 1) // lang_whole AS q FROM sized),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM weighed a JOIN weighed b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM weighed WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
""",
    "op3_pareto_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM totals),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS rank,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
chosen AS (SELECT level FROM levels WHERE level <= cap / w ORDER BY rank LIMIT 1),
rates AS (
  SELECT source, source_size, least(cap, w * (SELECT level FROM chosen)) AS target,
         CASE WHEN source_size > 0 THEN least(cap, w * (SELECT level FROM chosen)) / source_size ELSE 0 END AS rate
  FROM levels),
classed AS (SELECT *, CASE WHEN size > 0 THEN len(bin(size)) ELSE 0 END AS class FROM sized),
words AS (
  SELECT c.source, class, class + 1 AS w, CAST(sum(size) AS BIGINT) AS words, any_value(r.source_size) AS source_size, any_value(r.target) AS target
  FROM classed c JOIN rates r ON c.source IS NOT DISTINCT FROM r.source GROUP BY c.source, class),
-- for each number of classes that reach two copies, from the longest down, the level that the others would get
options AS (
  SELECT a.source, a.class,
         (any_value(a.target) - 2.0::DOUBLE * CAST(coalesce(sum(b.words) FILTER (b.class > a.class), 0) AS BIGINT)) / CAST(nullif(sum(b.w * b.words) FILTER (b.class <= a.class), 0) AS BIGINT) AS level,
         any_value(a.w) AS w
  FROM words a JOIN words b ON a.source IS NOT DISTINCT FROM b.source GROUP BY a.source, a.class),
picked AS (SELECT source, max_by(level, class) AS level, max(class) AS class FROM options WHERE level * w <= 2.0::DOUBLE GROUP BY source),
expected AS (
  SELECT x.*, CASE WHEN x.source_size = 0 THEN 0.0::DOUBLE WHEN x.class <= p.class THEN p.level * x.w ELSE 2.0::DOUBLE END AS copies
  FROM words x LEFT JOIN picked p ON x.source IS NOT DISTINCT FROM p.source),
split AS (
  SELECT *, floor(copies) AS whole, copies - floor(copies) AS part,
         target - CAST(sum(CAST(floor(copies) AS BIGINT) * words) OVER (PARTITION BY source) AS BIGINT) AS rest
  FROM expected),
ranked AS (
  SELECT c.doc_id, c.size, s.source_size, s.target, s.whole, s.part, s.rest,
         sum(CASE WHEN s.part > 0 THEN c.size ELSE 0 END) OVER (
           PARTITION BY c.source ORDER BY CASE WHEN s.part > 0 THEN (c.u / (1 - c.u)) / (s.part / (1 - s.part)) END NULLS LAST, c.doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS running
  FROM classed c JOIN split s ON c.source IS NOT DISTINCT FROM s.source AND c.class = s.class)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN part > 0 AND running - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
""",
}
