"""The queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import bpe, knn, langid, mixing, ogg, pii, quality, simhash, sstable, templates
from logloom.llm.common import read


def RANKS() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def TOKENIZER() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("source")


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read(sstable.write(read(spark, sf_dir, "documents"), TOKENIZER(), end_id=2))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(read(spark, sf_dir, "pages"))


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.described(ogg.stored(read(spark, sf_dir, "documents")))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fitted = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, fitted).withColumn("held_out", langid.held_out())


def op7_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.join(read(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read(spark, sf_dir, "documents"), bpe.load_ranks(spark, RANKS()), pattern())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_sstable": op2_sstable,
        "op3_pii": op3_pii,
        "op4_templates": op4_templates,
        "op5_ogg": op5_ogg,
        "op6_langid": op6_langid,
        "op7_knn": op7_knn,
        "op8_quality": op8_quality,
        "op9_bpe": op9_bpe,
        "op10_simhash": op10_simhash,
        "pipeline": pipeline,
    }


#: A word's place in a source's line follows from md5, which both engines have, so the whole mix can be said in SQL.
_OP1 = r"""
WITH sized AS (
  SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\x0C\r]+'))::BIGINT AS size,
    md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS place FROM documents),
of_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight, 3 * source_size AS cap FROM of_source),
rising AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open, sum(source_size) OVER ()::BIGINT AS total
  FROM weighted WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
levels AS (SELECT *, max(CASE WHEN (total - capped) / open * weight <= cap THEN (total - capped) / open END) OVER () AS level FROM rising),
targets AS (SELECT source, source_size, CASE WHEN level IS NULL OR level * weight > cap THEN cap::DOUBLE ELSE level * weight END AS target FROM levels),
blocked AS (SELECT *, least(128, pow(2.0, floor(log2(greatest(target / 100, 1.0)))))::BIGINT AS block FROM targets),
houses AS (SELECT *, ceil(source_size / block)::BIGINT AS blocks, sum(target) OVER h AS wanted, floor(sum(target) OVER h / block + 0.5)::BIGINT AS house, count(*) OVER h AS sources
  FROM blocked WINDOW h AS (PARTITION BY block)),
based AS (SELECT *, least(CASE WHEN target > 0 THEN floor(target / (wanted / greatest(house - sources, 1)) + 0.5) ELSE 0 END::BIGINT, 3 * blocks) AS base FROM houses),
due AS (SELECT *, greatest(0, house - sum(base) OVER (PARTITION BY block))::BIGINT AS due FROM based),
bids AS (SELECT source, block, due, target, base + unnest(range(1, least(due, 3 * blocks - base) + 1)) AS nth FROM due WHERE target > 0),
won AS (SELECT source AS winner, count(*) AS won FROM (SELECT source, due, row_number() OVER (PARTITION BY block ORDER BY target / (2 * nth - 1) DESC, source NULLS LAST, nth) AS rank FROM bids) WHERE rank <= due GROUP BY source),
plan AS (SELECT due.*, base + coalesce(won, 0) AS seats FROM due LEFT JOIN won ON source IS NOT DISTINCT FROM winner),
lined AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized),
placed AS (SELECT l.*, l.start + l.size AS stop, p.source_size, p.target, p.block, p.blocks AS n, p.seats AS q, l.start // p.block AS first, (l.start + l.size - 1) // p.block AS last
  FROM lined l JOIN plan p ON l.source IS NOT DISTINCT FROM p.source),
points AS (SELECT row, source, n, q, unnest([0, 1, 2, 3]) AS point, unnest([first, first + 1, last, last + 1]) AS i FROM placed WHERE size > 0),
sharded AS (SELECT *, (128 * i + 63) // (2 * n) AS k FROM points),
edged AS (SELECT *, (2 * k * n + 64) // 128 AS b0, (2 * (k + 1) * n + 64) // 128 AS b1 FROM sharded),
seated AS (SELECT *, (2 * b0::HUGEINT * q + n) // (2 * n) AS s0, (2 * b1::HUGEINT * q + n) // (2 * n) AS s1, greatest(b1 - b0, 1) AS m,
    ('0x' || substr(md5('17:' || coalesce(source, '') || ':' || k), 1, 8))::BIGINT % greatest(b1 - b0, 1) AS a FROM edged),
filled AS (SELECT row, point, s0 + ((s1 - s0) // m) * (i - b0) + ((a + i - b0) * ((s1 - s0) % m) // m) - (a * ((s1 - s0) % m) // m) AS h FROM seated),
four AS (SELECT row, max(h) FILTER (point = 0) AS f0, max(h) FILTER (point = 1) AS f1, max(h) FILTER (point = 2) AS l0, max(h) FILTER (point = 3) AS l1 FROM filled GROUP BY row)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 WHEN first = last THEN (f1 - f0) * size
  ELSE (f1 - f0) * (block * (first + 1) - start) + block * (l0 - f1) + (l1 - l0) * (stop - block * last) END::BIGINT AS taken,
  CASE WHEN size > 0 THEN (128 * first + 63) // (2 * n) END::BIGINT AS shard
FROM placed LEFT JOIN four USING (row)
"""


_OP7 = """
WITH whole AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": _OP1, "op7_knn": _OP7}
