"""Registered queries of this subpackage and the SQL that must give the same rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.llm import (
    alignment, chaining, decontaminate, hard_negatives, language_id, mixing, ngram_lm, order_minhash, prefix_tree_join, secret_scan,
    suffix_dedup, toxicity, url_filter)
from basketry.registry.query import Query
from basketry.session import spool


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("overlap.spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id", F.col("overlap.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP1_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), n AS (
  SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM n)
), dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM n) WHERE len(w) >= n)
), h AS (
  SELECT r, i, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g
), words AS (
  SELECT r, count(DISTINCT place) AS hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r
), ids AS (
  SELECT r, count(*) AS k, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(k, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    apart = language_id.held_out("doc_id", 4, 2)
    model = language_id.fit(docs.filter(~apart).select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", "text", apart.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree_join.similar_components(_read(spark, sf_dir, "documents"))


OP3_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), g AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM g GROUP BY r
), common AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT r AS a, r AS b FROM d UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach ON reach.a = d.r JOIN d o ON o.r = reach.b GROUP BY d.r, d.doc_id, n.n
"""


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk
  FROM documents
), s AS (
  SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sk
), w AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY sk) - 1) % 3 + 1 AS INT)] AS wt, row_number() OVER (ORDER BY sk) AS i FROM s
), c AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / wt AS stop FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY stop, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(wt) OVER (ORDER BY stop, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM c
), t AS (
  SELECT sk, source_size, CASE WHEN stop < lev THEN CAST(cap AS DOUBLE)
         ELSE max(CASE WHEN NOT stop < lev THEN lev END) OVER () * wt END AS target
  FROM l
), k AS (
  SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         sum(size) OVER (PARTITION BY d.sk ORDER BY md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || d.sk)
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d JOIN t ON d.sk = t.sk
)
SELECT doc_id, source, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(least(budget - (budget // source_size) * source_size - before, size), 0) END AS BIGINT) AS taken
FROM k
"""


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    apart = language_id.held_out("doc_id", 10, 0)
    model, counts = ngram_lm.fit(docs.filter(~apart).select("text"))
    return ngram_lm.score_texts(docs.select("doc_id", apart.alias("held_out"), "text"), model, counts)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_with_edits(_read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_strings(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op9_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.fuzzy_passages(_read(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_read(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_scan.BASE))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    verdicts = lambda v: F.size(F.filter("secrets", lambda s: s["verdict"] == v)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.PATTERNS],
        F.sha2(text(base), 256).alias("base_sha256"), text("secrets").alias("spans"),
        verdicts("live").alias("n_live"), verdicts("example").alias("n_example"))


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False, digest=True)
    return alignment.rate_links(spool(aligned, "links")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id NULLS LAST) AS place FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.other_id NULLS LAST) AS rank
  FROM p JOIN s ON p.place <= 5 AND s.anchor = p.anchor AND NOT s.same
                AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels").select("doc_id", "toxic")
    apart = language_id.held_out("doc_id", 5, 0)
    lexicon = toxicity.fit(docs, labels.filter(~apart))
    return toxicity.score(docs.select("doc_id", apart.alias("held_out"), "text"), lexicon).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": Query(op1_decontaminate, OP1_SQL),
        "op2_language_id": Query(op2_language_id),
        "op3_ngram_join": Query(op3_ngram_join, OP3_SQL),
        "op4_source_mix": Query(op4_source_mix, OP4_SQL),
        "op5_ngram_lm": Query(op5_ngram_lm),
        "op6_url_filter": Query(op6_url_filter),
        "op7_order_minhash": Query(op7_order_minhash),
        "op8_suffix_dedup": Query(op8_suffix_dedup),
        "op9_chained_passages": Query(op9_chained_passages),
        "op10_secret_scan": Query(op10_secret_scan),
        "op11_align_tokenizers": Query(op11_align_tokenizers),
        "op12_hard_negatives": Query(op12_hard_negatives, OP12_SQL),
        "op13_toxicity": Query(op13_toxicity),
    }
