"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html, lines, phrases, quality, repeats, simhash, toxicity, tries, vectors, warc


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(spark, warc.captures(table(spark, sf_dir, "pages")))
    pairs = F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select("record_id", "canonical", F.col("at").alias("at_time"), "status", "base_id", "outcome", F.array_join(pairs, ";").alias("merged"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark, table(spark, sf_dir, "pages"))


def op4_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op6_sparse_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated(spark, table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(spark, table(spark, sf_dir, "documents"), vocabulary())


def op8_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of ids and decoded."""
    line = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(line, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(spark, table(spark, sf_dir, "documents"), vocabulary())


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.grafted_trie(spark, table(spark, sf_dir, "conversations"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_simhash_near_dedup, op2_warc_revisits, op3_html_main_text, op4_quality_discriminant, op5_embedding_near_dedup, op6_sparse_suffix_repeats, op7_token_counts, op8_toxicity_machine, op9_bpe_round_trip, op10_benchmark_leaks, op11_line_dedup, op12_conversation_trie, op13_phrase_collocations]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_revisits": r"""
WITH p AS (
  SELECT page_id AS k, coalesce(html, '') AS h, regexp_replace(trim(url), '#.*$', '') AS bare,
    regexp_replace(regexp_replace(bare, '[?].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest,
    list_sort([x for x in string_split(regexp_extract(bare, '[?](.*)$', 1), '&') if x <> '' AND NOT starts_with(x, 'utm_')]) AS asked FROM pages),
c AS (
  SELECT k, h, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/]*', 0)), '^(www|m)\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '/.*$', 0), '/+$', '') || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS canonical, '"' || md5(h) || '"' AS tag FROM p),
f AS (SELECT 'r' || k AS record_id, canonical, k * 10 AS at_time, CASE WHEN k % 5 <> 3 THEN tag END AS etag, 'day ' || (k % 365) AS day, strlen(h) AS n FROM c),
v AS (
  SELECT 'v' || k AS record_id, k, canonical, k * 10 + CASE WHEN k % 9 = 0 THEN -5 ELSE 10 * (k % 50) + 5 END AS at_time,
    CASE WHEN k % 7 = 0 THEN 'W/' || tag WHEN k % 7 = 1 THEN '"other"' WHEN k % 7 < 5 THEN tag END AS etag,
    CASE WHEN k % 7 = 5 THEN 'day ' || (k % 365) WHEN k % 7 = 6 THEN 'never' END AS day FROM c),
j AS (
  SELECT v.*, f.record_id AS base_id, f.etag AS base_etag, f.day AS base_day, f.n FROM v ASOF LEFT JOIN f ON v.canonical = f.canonical AND v.at_time > f.at_time),
o AS (
  SELECT *, CASE WHEN base_id IS NULL THEN 'no base'
    WHEN etag IS NOT NULL AND base_etag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = base_etag THEN 'resolved' ELSE 'validator mismatch' END
    WHEN day IS NOT NULL AND base_day IS NOT NULL THEN CASE WHEN day = base_day THEN 'resolved' ELSE 'validator mismatch' END
    ELSE 'unproven' END AS outcome FROM j)
SELECT record_id, canonical, at_time, 200 AS status, NULL AS base_id, 'full' AS outcome,
  'cache-control=max-age=60;content-length=' || n || ';last-modified=' || day AS merged FROM f
UNION ALL
SELECT record_id, canonical, at_time, 304, base_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control=max-age=90;content-length=' || n || ';date=time ' || k || ';last-modified=' || base_day END FROM o""",
        "op5_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, (SELECT min(b) FROM r WHERE r.a = v.vec_id) AS component_id,
  vec_id = (SELECT min(b) FROM r WHERE r.a = v.vec_id) AS kept FROM v""",
        "op11_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS line FROM d),
k AS (
  SELECT r, doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r""",
        "op13_phrase_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda y: y <> '') AS x FROM p),
i AS (SELECT lang, x, unnest(range(1, len(x) + 1)) AS i FROM w),
k AS (SELECT lang, x[i:i + k - 1] AS x, k FROM i CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(x)),
f AS (SELECT lang, x, k, array_to_string(x, ' ') AS phrase, count(*)::HUGEINT AS f FROM k GROUP BY lang, x, k),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
j AS (SELECT lang, x, k, phrase, f AS a, unnest(range(1, k)) AS j FROM c),
s AS (
  SELECT j.*, l.f AS l, r.f AS r, (2000000 * a) // (l.f + r.f) AS score FROM j
  JOIN f l ON l.lang = j.lang AND l.x = j.x[:j] JOIN f r ON r.lang = j.lang AND r.x = j.x[j + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, j) = 1),
h AS (SELECT lang, x[a:a + m - 1] AS x, max(f) AS f FROM c CROSS JOIN (SELECT unnest([2, 3]) AS m) CROSS JOIN (SELECT unnest([1, 2, 3]) AS a)
  WHERE m < k AND a + m - 1 <= k GROUP BY 1, 2),
o AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.x = b.x WHERE h.f IS NULL OR 100 * h.f < 80 * b.a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT z.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000""",
        "op12_conversation_trie": r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS o FROM conversations WHERE conv_id IS NOT NULL),
i AS (
  SELECT DISTINCT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(c::VARCHAR, '')])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 9 AS h FROM t),
r AS (
  SELECT i.c, o, role, text FROM i JOIN t ON t.c = i.base AND o <= h
  UNION ALL SELECT i.c, 8 + o, role, text FROM i JOIN t ON t.c = i.c AND o > h),
s AS (SELECT c, list([role, text] ORDER BY o) AS l FROM r GROUP BY c),
a AS (SELECT i.c, coalesce(l, []) AS l FROM i LEFT JOIN s ON i.c = s.c),
p AS (SELECT c, d, l[:d] AS k, len(l) = d AS ends, CASE WHEN d > 0 THEN strlen(l[d][2]) ELSE 0 END AS b FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM a)),
n AS (SELECT d, k, min(c) AS id, count(*) AS n_convs, max(b) AS b, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends) AS e FROM p GROUP BY d, k),
q AS (SELECT n.*, m.id AS parent FROM n LEFT JOIN n m ON m.d = n.d - 1 AND m.k = n.k[:n.d - 1]),
z AS (SELECT q.*, (SELECT count(*) FROM q x WHERE x.d = q.d + 1 AND x.parent = q.id) AS kids FROM q),
u AS (SELECT DISTINCT id, d, up, up_d, kids, n_convs, b FROM (SELECT z.id, z.d, kids, z.n_convs, z.b, unnest(range(0, z.d + 1)) AS up_d, k FROM z) y
  JOIN (SELECT id AS up, d AS dd, k AS kk FROM n) v ON v.dd = y.up_d AND v.kk = y.k[:y.up_d])
SELECT z.id AS conv_id, z.d AS depth, z.parent AS parent_conv_id, z.n_convs, z.kids AS n_children,
  (SELECT count(*) FROM u WHERE u.up = z.id AND u.up_d = z.d AND u.kids = 0) AS n_leaves,
  (SELECT sum((u.n_convs - 1) * u.b) FROM u WHERE u.up = z.id AND u.up_d = z.d)::BIGINT AS saved_tokens, sha256(coalesce(z.e, '')) AS ends_sha256 FROM z""",
    }
