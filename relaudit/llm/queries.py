"""The numbered operators as registered queries, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, codes, hardneg, langid, licenses, mixing, neardup, ngram, packing, secrets, stock, toxicity
from .common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 3) == 1
    scorer = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, scorer).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    parser = langid.fit_parser(docs.where(~held_out))
    return langid.identify(docs, parser).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.jaccard_groups(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    domain = mixing.quality_domain(F.col("quality")).alias("domain")
    rows = mixing.mix(docs, labels.select("doc_id", domain), keep=["doc_id"])
    return rows.select("doc.doc_id", F.col("tokens").alias("n_tokens"), *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(sorted(mixing.TARGETS))], "rate", "residual")


def op8_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select(*extra.columns).union(extra)
    return chat.digest(chat.examples(turns))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, id_ = _table(spark, sf_dir, "embeddings").where("label is not null"), F.col("vec_id")
    label = F.when(id_ % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors.withColumn("label", label), id_ % 50 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.coded(_table(spark, sf_dir, "embeddings"))


def op13_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock.pack(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_language_id, op3_secret_scan, op4_best_fit_packing, op5_embedding_near_dedup, op6_ngram_jaccard,
        op7_source_mixing, op8_collision_ann, op9_chat_format, op10_license_scan, op11_hard_negatives, op12_vector_codes, op13_stock_packing,
    )
}

#: SQL where it can express a query: all pairs, in full, and the components they make.
_REACH = """both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(id, r) AS (SELECT id, id FROM ids UNION SELECT reach.id, both_ways.y FROM reach JOIN both_ways ON reach.r = both_ways.x)"""

#: Each part to its nearest entry by the codebooks c{m}, and the codebooks that follow.
_NEAREST = """a{n} AS (SELECT vec_id, p, e, x, d FROM (SELECT vec_id, x.p, e, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM x JOIN c{m} c ON c.p = x.p) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)"""
_ROUND = (
    _NEAREST
    + """,
m{n} AS (SELECT p, e, [CAST(floor(sum(x[1]) / count(*)) AS BIGINT), CAST(floor(sum(x[2]) / count(*)) AS BIGINT),
  CAST(floor(sum(x[3]) / count(*)) AS BIGINT), CAST(floor(sum(x[4]) / count(*)) AS BIGINT)] AS c FROM a{n} GROUP BY p, e),
c{n} AS (SELECT o.p, o.e, coalesce(m.c, o.c) AS c FROM c{m} o LEFT JOIN m{n} m ON m.p = o.p AND m.e = o.e)"""
)

ORACLE_SQL: dict[str, str] = {
    "op5_embedding_near_dedup": f"""WITH RECURSIVE ids AS (SELECT DISTINCT vec_id AS id FROM embeddings),
good AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
{_REACH},
n AS (SELECT x, count(*) AS n FROM both_ways GROUP BY x)
SELECT id AS vec_id, coalesce(any_value(n), 0) AS n_links, min(r) AS component_id, id = min(r) AS kept FROM reach LEFT JOIN n ON id = x GROUP BY id""",
    "op6_ngram_jaccard": rf"""WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)),
{_REACH}
SELECT id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON doc_id = id GROUP BY id""",
    "op9_chat_format": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized AS (SELECT *, 14 + length(role) + length(text) + length(regexp_replace(concat(role, text), '[^\\#<:]', '', 'g')) AS size FROM t),
run AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM run GROUP BY conv_id""",
    "op11_hard_negatives": """WITH g AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op12_vector_codes": f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, p, v[p * 4 + 1:p * 4 + 4] AS x FROM k, range(16) t(p)),
c0 AS (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x AS c FROM x WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
{_ROUND.format(n=1, m=0)}, {_ROUND.format(n=2, m=1)},
{_NEAREST.format(n=3, m=2)},
t AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(i, ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, j, CAST(c[j] AS VARCHAR) AS i FROM c2, range(1, 5) t(j)))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM t JOIN k USING (vec_id), h""",
}
