"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import audit
from .automata import remove_known_words
from .common import table
from .cosine import near_vectors
from .decontaminate import contamination
from .maintext import main_texts
from .neardup import near_duplicates
from .packing import pack
from .periods import periodic_runs, planted_tail, run_digests
from .sharding import shard
from .suffixes import remove_repeats
from .tokencount import token_counts
from .topk import search
from .toxicity import fit_toxicity, held_out, score_toxicity

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TOKEN_LIMIT = 1024
SHARD_BYTES = 1_000_000


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[make.__name__] = make
    return make


@query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every document, at most 1 MB of text each."""
    return shard(table(spark, folder, "documents"), SHARD_BYTES)


# Every prefix of the hash bits with its size; a row's shard is the shortest that fits, below none that does.
SQL["op2_sharding"] = f"""
WITH hashed AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT)), 60, '0') AS bits,
         row_number() OVER () AS row_id
  FROM documents
), paths AS (
  SELECT row_id, doc_id, n_bytes, CAST(d.depth AS INTEGER) AS depth, substr(bits, 1, CAST(d.depth AS INTEGER)) AS shard
  FROM hashed, generate_series(0, 60) AS d(depth)
), sizes AS (
  SELECT depth, shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM paths GROUP BY depth, shard
), fitting AS (
  SELECT p.row_id, p.doc_id, p.n_bytes, p.shard, p.depth, s.shard_bytes,
         row_number() OVER (PARTITION BY p.row_id ORDER BY p.depth) AS nth
  FROM paths p JOIN sizes s ON p.depth = s.depth AND p.shard = s.shard
  WHERE s.shard_bytes <= {SHARD_BYTES} OR p.depth = 60
)
SELECT doc_id, n_bytes, shard, depth, shard_bytes FROM fitting WHERE nth = 1
"""


@query
def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The article of every page."""
    return main_texts(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate group of every document: four-word shingles, similarity of 0.8 or more."""
    return near_duplicates(table(spark, folder, "documents"), width=4, percent=80)


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents hold passages of which benchmark items."""
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the 50-byte strings that earlier ones have."""
    found = remove_repeats(table(spark, folder, "documents"), width=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the 13-word windows that earlier ones have."""
    found = remove_known_words(table(spark, folder, "documents"), width=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = table(spark, folder, "documents")
    model = fit_toxicity(docs, table(spark, folder, "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document by the byte-level tokenizer."""
    counts = token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op10_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five best other vectors of every 50th one."""
    return search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


SQL["op10_top_k"] = """
WITH parts AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


@query
def op11_period_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The periodic runs of every document and what is left without their repeats."""
    return run_digests(periodic_runs(table(spark, folder, "documents"), tail=planted_tail))


@query
def op12_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The near duplicates of every vector within its label: cosine of 0.98 or more."""
    return near_vectors(table(spark, folder, "embeddings"), threshold=0.98)


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes at each place of all their orders, by language."""
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


# Components by carrying the smallest id along the links, which are few.
SQL["op12_near_vectors"] = """
WITH RECURSIVE parts AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), normed AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM parts WHERE len(v) > 0 AND list_dot_product(v, v) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM normed a JOIN normed b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id AS id, vec_id AS reached FROM embeddings
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON r.reached = l.a
), smallest AS (
  SELECT id, min(reached) AS component_id FROM reach GROUP BY id
), degrees AS (
  SELECT a AS id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, s.component_id, e.vec_id = s.component_id AS kept
FROM embeddings e JOIN smallest s ON e.vec_id = s.id LEFT JOIN degrees d ON e.vec_id = d.id
"""

SQL["op13_filter_audit"] = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), masks AS (
  SELECT t.doc_id, t.part,
         CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]+', '', 'g')) > 10 * length(t.text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN t.doc_id > f.first_id THEN 16 ELSE 0 END AS mask
  FROM texts t JOIN firsts f ON t.text = f.text
), cells AS (
  SELECT m.part, m.mask, count(*) AS n, coalesce(sum(k.good), 0) AS good, coalesce(sum(k.toxic), 0) AS toxic
  FROM masks m LEFT JOIN known k ON m.doc_id = k.doc_id GROUP BY m.part, m.mask
), letters(letter, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT '' AS filter_order, 0 AS applied
  UNION ALL
  SELECT o.filter_order || l.letter, o.applied + l.bit FROM orders o JOIN letters l ON (o.applied & l.bit) = 0
), steps AS (
  SELECT o.filter_order, CAST(s.step AS INTEGER) AS step, l.letter, l.bit,
         (SELECT coalesce(sum(b.bit), 0) FROM letters b WHERE strpos(substr(o.filter_order, 1, CAST(s.step AS INTEGER) - 1), b.letter) > 0) AS before
  FROM orders o, generate_series(1, 5) AS s(step), letters l
  WHERE length(o.filter_order) = 5 AND l.letter = substr(o.filter_order, CAST(s.step AS INTEGER), 1)
), metrics AS (
  SELECT c.part, s.filter_order, s.step, s.letter,
         CAST(sum(CASE WHEN (c.mask & CAST(s.before + s.bit AS INTEGER)) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN (c.mask & s.bit) <> 0 AND (c.mask & CAST(s.before AS INTEGER)) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN (c.mask & s.bit) <> 0 AND (c.mask & CAST(s.before AS INTEGER)) <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN c.mask = s.bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN (c.mask & s.bit) <> 0 AND (c.mask & CAST(s.before AS INTEGER)) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN (c.mask & s.bit) <> 0 AND (c.mask & CAST(s.before AS INTEGER)) = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cells c, steps s GROUP BY c.part, s.filter_order, s.step, s.letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM metrics
"""
