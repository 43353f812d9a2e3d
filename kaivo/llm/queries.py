"""The registered queries of the ten operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kaivo.llm import html, langid, licenses, mixing, neardup, packing, passages, quality, sharding, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 1024 tokens: one row per piece."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(_table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the cascade's verdict."""
    return quality.judge(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every vector at cosine >= 0.9, over all pairs."""
    return vectors.join(_table(spark, sf_dir, "embeddings")).drop("class_id")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every document at Jaccard >= 0.8 of its 5-word shingles."""
    return neardup.join(_table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every passage of 50 words or more that stands in two documents."""
    return passages.spans(_table(spark, sf_dir, "documents")).drop("version")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of near equal bytes."""
    found = sharding.shard(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of those whose crc32(doc_id) mod 4 isn't 2."""
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to the sources' target weights."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "epochs")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_html_extraction, op3_quality_rules, op4_embedding_neardup, op5_ngram_jaccard_join, op6_suffix_array_dedup, op7_sharding, op8_license_scan, op9_language_id, op10_mixing)}


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

_SHINGLES = rf"""
row AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, text FROM documents),
sh0 AS MATERIALIZED (SELECT r, {_WORDS} AS w FROM row WHERE text IS NOT NULL),
sh AS MATERIALIZED (
    SELECT DISTINCT r, hash(s) AS s FROM (
        SELECT r, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, chr(32))]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(32))) END) AS s
        FROM sh0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM sh GROUP BY 1),
link AS MATERIALIZED (
    SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.r <> y.r GROUP BY 1, 2) p
    JOIN n n1 ON n1.r = a JOIN n n2 ON n2.r = b WHERE c / (n1.n + n2.n - c) >= 0.8)"""

ORACLE = {
    "op4_embedding_neardup": """
WITH RECURSIVE m AS MATERIALIZED (SELECT vec_id, embedding, row_number() OVER () AS r FROM embeddings),
e AS MATERIALIZED (
    SELECT r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM m
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT x.r AS a, y.r AS b FROM e x JOIN e y ON x.r <> y.r AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
reach AS (SELECT a, a AS b FROM (SELECT DISTINCT a FROM link) UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a AS r, min(vec_id) AS c FROM reach JOIN m ON m.r = b GROUP BY 1)
SELECT m.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(c.c, m.vec_id) AS component_id, coalesce(c.c, m.vec_id) IS NOT DISTINCT FROM m.vec_id AS kept
FROM m LEFT JOIN (SELECT a AS r, count(*) AS n FROM link GROUP BY 1) k USING (r) LEFT JOIN least c USING (r)
""",
    "op5_ngram_jaccard_join": f"""
WITH RECURSIVE {_SHINGLES},
same AS (SELECT r, min(doc_id) OVER (PARTITION BY h1, h2, n) AS class_id FROM (SELECT r, count(*) AS n, sum(s::HUGEINT) AS h1, bit_xor(hash(s, 7)) AS h2 FROM sh GROUP BY 1) JOIN row USING (r)),
reach AS (SELECT a, a AS b FROM (SELECT DISTINCT a FROM link) UNION SELECT x.a, l.b FROM reach x JOIN link l ON x.b = l.a),
least AS (SELECT a AS r, min(doc_id) AS c FROM reach JOIN row ON row.r = b GROUP BY 1)
SELECT d.doc_id, coalesce(s.class_id, d.doc_id) AS class_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) IS NOT DISTINCT FROM d.doc_id AS kept
FROM row d LEFT JOIN same s USING (r) LEFT JOIN n USING (r) LEFT JOIN (SELECT a AS r, count(*) AS n FROM link GROUP BY 1) k USING (r) LEFT JOIN least c USING (r)
""",
    "op6_suffix_array_dedup": rf"""
WITH d AS (SELECT doc_id, text, any_value(w) AS w FROM (SELECT doc_id, text, {_WORDS} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) GROUP BY 1, 2),
win AS MATERIALIZED (
    SELECT doc_id, t, i - 1 AS start, hash(array_to_string(w[i:i + 49], chr(32))) AS h FROM (SELECT doc_id, md5(text) AS t, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
rep AS (SELECT h, min(doc_id) AS first_doc_id FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, t, start, first_doc_id, doc_id <> first_doc_id AS duplicate FROM win JOIN rep USING (h)),
run AS (SELECT *, start - row_number() OVER (PARTITION BY doc_id, t, duplicate ORDER BY start) AS run FROM hit)
SELECT doc_id, min(start)::BIGINT AS start_word, (max(start) - min(start) + 50)::BIGINT AS n_words, duplicate, arg_min(first_doc_id, start) AS first_doc_id FROM run GROUP BY doc_id, t, duplicate, run
""",
    "op3_quality_rules": rf"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, coalesce({_WORDS}, []) AS w FROM documents),
line AS (SELECT r, x FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM line GROUP BY 1),
tri AS MATERIALIZED (SELECT r, i, hash(w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, g) > 1), range(3) t(k) GROUP BY 1),
top AS (SELECT r, max(n) AS top FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY 1, 2) GROUP BY 1),
f AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines, coalesce(top, 0) AS top, len(regexp_extract_all(text, '[A-Z]')) AS upper, len(regexp_extract_all(text, '[0-9]')) AS digits,
        len(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{10FFFF}}]')) AS letters, len(regexp_extract_all(text, '[\x{{80}}-\x{{BF}}]')) AS odd
    FROM d LEFT JOIN lines USING (r) LEFT JOIN rep USING (r) LEFT JOIN top USING (r)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR n_symbols * 10 > n_words OR 2 * n_dup_lines > greatest(n_lines, 1) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
        OR 2 * upper > letters OR digits * 10 > word_chars * 4 OR 2 * letters < word_chars - odd OR top * 10 > n_words * 3) AS kept
FROM g
""",
    "op10_mixing": r"""
WITH k AS MATERIALIZED (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat('mix-1|', coalesce(doc_id::VARCHAR, ''), '|', coalesce(text, ''))) AS m,
        coalesce(length(translate(text, '#*$%&|<>!{}[]=_~^\', '')) / greatest(length(text), 1)::DOUBLE, 0) AS plain FROM documents),
key AS MATERIALIZED (SELECT doc_id, source, size, -ln((('0x' || m[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / round(greatest(0.1, plain * plain * plain * plain), 4) AS key FROM k),
src AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight FROM key GROUP BY source),
lev AS (SELECT *, source_size * 3.0::DOUBLE AS most, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3.0 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY source_size * 3.0 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM src),
goal AS (SELECT source, source_size, least(most, coalesce(max(CASE WHEN lev <= most / weight THEN lev END) OVER () * weight, most)) AS target FROM lev),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END::BIGINT AS epochs FROM goal),
bud AS (SELECT *, greatest(0, round(target - epochs * source_size))::BIGINT AS budget FROM plan),
run AS (SELECT k.*, source_size, target, epochs, budget, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM key k JOIN bud b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken, epochs FROM run
""",
}
