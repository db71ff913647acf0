"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwell.llm import asof, collocations, decontam, licenses, lm, neardup, packing, quality, secrets, tokencounts, tokenstore, topk, urls
from gridwell.session import ship, table


def vocabulary_path(name: str) -> str:
    """A public vocabulary file's place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path("word_bpe_49k.json"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in urls.RULES) + " AS rules(verdict, host, path)")
    return urls.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return tokenstore.read(spark, tokenstore.write(docs, vocabulary_path("byte_bpe_50k.json")))


def op11_point_in_time_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars", "lang")
    return asof.features_at_labels(docs, table(spark, sf_dir, "labels", "doc_id"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents", "text", "lang"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path("byte_bpe_50k.json"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
),
sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s
  FROM w
),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh),
f AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
r AS (SELECT e.* FROM e JOIN f USING (x)),
p AS (
  SELECT a.doc_id AS i, b.doc_id AS j FROM r a JOIN r b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
l AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p),
cc(id, comp) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.j, min(cc.comp) FROM cc JOIN l ON cc.id = l.i JOIN recurring.cc t ON t.id = l.j
  WHERE cc.comp < t.comp GROUP BY l.j
),
c AS (SELECT id, min(comp) AS comp FROM cc GROUP BY id)
SELECT sh.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, comp AS component_id, sh.doc_id = comp AS kept
FROM sh JOIN c ON c.id = sh.doc_id
"""

OP7_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
),
rules(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT h.page_id, h.host, h.path, rh || rp AS rule, verdict,
    row_number() OVER (PARTITION BY h.page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM h LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


_HASHED = ", ".join(f"CAST(concat('0x', substr(sha256(CAST(doc_id AS VARCHAR)), {1 + 8 * i}, 8)) AS BIGINT) AS {c}" for i, c in enumerate("abcd"))

OP11_SQL = f"""
WITH h AS (SELECT doc_id, source, n_chars, lang, {_HASHED} FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL),
v AS (SELECT doc_id, source, n_chars, lang, a % 50000 AS event, a % 50000 - 60 + b % 600 AS arrival, a % 50000 + c % 900 AS expiry FROM h),
q AS (SELECT row_number() OVER () AS row, doc_id, d % 50000 AS t FROM (SELECT doc_id, {_HASHED} FROM labels)),
s AS (SELECT doc_id, min(source) AS source FROM h GROUP BY doc_id),
m AS (
  SELECT q.row, q.doc_id, q.t, v.doc_id AS version_id, q.t - v.event AS age, v.n_chars, v.lang,
    row_number() OVER (PARTITION BY q.row ORDER BY v.event DESC NULLS LAST, v.arrival, v.doc_id DESC, v.n_chars DESC NULLS LAST, v.lang DESC NULLS LAST) AS k
  FROM q LEFT JOIN s ON s.doc_id = q.doc_id LEFT JOIN v ON v.source = s.source AND v.event <= q.t AND v.arrival <= q.t AND q.t < v.expiry
)
SELECT doc_id, t, version_id, age, CASE WHEN version_id IS NULL THEN 'none' WHEN age > 120 THEN 'stale' ELSE 'fresh' END AS status,
  CASE WHEN age <= 120 THEN n_chars END AS n_chars, CASE WHEN age <= 120 THEN lang END AS lang
FROM m WHERE k = 1
"""

OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k
),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (
  SELECT c.lang, c.k, c.phrase, c.a, j, l.a AS l, r.a AS r, n,
    CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM c, (SELECT unnest([1, 2, 3, 4]) AS j), f l, f r, total
  WHERE j < c.k AND l.lang = c.lang AND r.lang = c.lang AND total.lang = c.lang
    AND l.phrase = array_to_string(c.ws[1:j], ' ') AND r.phrase = array_to_string(c.ws[j + 1:], ' ')
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cut) WHERE o = 1),
inner_of AS (
  SELECT DISTINCT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM c, (SELECT unnest([2, 3, 4]) AS m), (SELECT unnest([1, 2, 3, 4]) AS i) WHERE m < k AND i + m - 1 <= k
),
kept AS (SELECT best.* FROM best ANTI JOIN inner_of ON inner_of.lang = best.lang AND inner_of.phrase = best.phrase AND 100 * inner_of.a >= 100 * best.a)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
) WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_exact_top_k,
        op2_best_fit_packing,
        op3_minhash_near_dedup,
        op4_secret_scan,
        op5_lm_scoring,
        op6_decontamination,
        op7_url_filter,
        op8_quality_classifier,
        op9_license_scan,
        op10_token_files,
        op11_point_in_time_join,
        op12_collocations,
        op13_token_counts,
    ]

    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: shipped(f) for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": OP1_SQL, "op3_minhash_near_dedup": OP3_SQL, "op7_url_filter": OP7_SQL, "op11_point_in_time_join": OP11_SQL, "op12_collocations": OP12_SQL}
