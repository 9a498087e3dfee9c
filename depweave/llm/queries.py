"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm import ann, bpe, mixing, neardup, phrases, quality, sharding, tokenbin, tokencount, topk, urlfilter, variants, warc

#: The rules that op2 judges by: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, urlfilter.rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_files(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, columns=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, columns=["doc_id"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_read(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents")).drop("at")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_archives(_read(spark, sf_dir, "pages"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_read(spark, sf_dir, "documents"), variants.Spelling(typo_every=31))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash, op2_url_filter, op3_token_files, op4_mixing, op5_sharding, op6_quality, op7_exact_top_k, op8_bpe, op9_token_counts, op10_nearest, op11_phrases, op12_warc, op13_variants)
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
shingles AS (SELECT doc_id, hash(t) AS h, md5(t) AS m FROM (SELECT doc_id, unnest(s) AS t FROM sets)),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.h = b.h AND a.m = b.m AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN roots USING (doc_id)
"""

_OP2 = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hits AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id
)
SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON h.page_id = p.page_id
"""

_OP4 = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source
), rooms AS (
  SELECT *, CAST([5, 2, 1][(place - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS room, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM sources
), leveled AS (
  SELECT *, (total - coalesce(sum(room) OVER (ORDER BY room / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY room / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM rooms
), final AS (SELECT level AS found FROM leveled WHERE level * weight <= room ORDER BY room / weight, place LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN level * weight > room OR (SELECT found FROM final) IS NULL THEN room ELSE least((SELECT found FROM final) * weight, room) END AS target FROM leveled
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM docs d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source
), budgets AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM placed)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
  + least(size, greatest(0, budget % source_size - before)) END AS BIGINT) AS taken FROM budgets
"""

_OP7 = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score FROM good q JOIN good d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
sized AS (SELECT lang, w, unnest(range(1, 6)) AS k FROM lists),
runs AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM sized WHERE len(w) >= k),
freq AS (SELECT lang, phrase, k, count(*) AS f FROM runs GROUP BY lang, phrase, k HAVING count(*) >= 100),
starts AS (SELECT lang, f, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS size FROM freq WHERE k > 2),
places AS (SELECT lang, f, w, size, unnest(range(1, k - size + 2)) AS pos FROM starts),
inner_ AS (SELECT lang, array_to_string(w[pos:pos + size - 1], ' ') AS phrase, max(f) AS longer FROM places GROUP BY 1, 2),
own AS (SELECT q.lang, q.phrase, q.k, q.f AS a FROM freq q LEFT JOIN inner_ i ON i.lang = q.lang AND i.phrase = q.phrase WHERE q.k > 1 AND (i.longer IS NULL OR 100 * i.longer < 100 * q.f)),
cuts AS (SELECT lang, phrase, a, k, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM own),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, c.cut, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score FROM cuts c
  JOIN freq x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN freq y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
  JOIN totals t ON t.lang = c.lang
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM scored),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank FROM best WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

_SIGN = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, {}, 10))::BIGINT >> {}) & 31 AS INTEGER) + 1, 1)"

_OP12 = f"""
WITH own AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS h, md5(payload) AS m FROM own),
firsts AS (SELECT h, m, min(page_id) AS first FROM digests GROUP BY h, m)
SELECT page_id, payload_bytes, {" || ".join(_SIGN.format(10 * g + 1, 35 - 5 * i) for g in range(4) for i in range(8))} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM digests JOIN firsts USING (h, m)
"""

#: The other operators hold what SQL can't express (tokenizers, a heap, a trained model, an index).
SQL = {"op1_minhash": _OP1, "op2_url_filter": _OP2, "op4_mixing": _OP4, "op7_exact_top_k": _OP7, "op11_phrases": _OP11, "op12_warc": _OP12}
