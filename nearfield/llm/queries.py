"""One registered query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm.reputation import LONG_SUFFIXES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op3_bloom_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from nearfield.llm import exact_dedup

    return exact_dedup.dedup(table(spark, folder, "documents"))


SQL["op3_bloom_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op9_budget_mix(spark: SparkSession, folder: str) -> DataFrame:
    from nearfield.llm import mixing

    return mixing.mix(table(spark, folder, "documents"))


SQL["op9_budget_mix"] = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM docs GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place FROM sources),
shares AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER lower_ones, 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER lower_ones, 0)) AS level FROM ranked
  WINDOW lower_ones AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT level FROM shares WHERE 3 * source_size >= level * weight ORDER BY place LIMIT 1),
budgets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target FROM sources, levels),
parts AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM budgets),
ordered AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.budget - p.epochs * p.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size, d.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM ordered
"""


@query
def op10_covering_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from nearfield.llm import simhash

    groups = simhash.near_groups(table(spark, folder, "documents"), words=4, radius=4)
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


@query
def op8_reduced_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from nearfield.llm import packing

    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_noisy_channel(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from nearfield.llm import toxicity

    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, folder, "labels").where(~held_out).select("doc_id", "toxic")
    scored = toxicity.toxicity(table(spark, folder, "documents"), labels)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", predicted)


SQL["op4_warc_members"] = """
WITH pay AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex,
         min(page_id) OVER (PARTITION BY html) AS least_id FROM pay)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex || '0', (5 * i // 4 + 1)::INTEGER, 2))::INTEGER >> (3 - 5 * i % 4)::INTEGER) & 31), 1)), '')
         AS payload_digest,
       CASE WHEN least_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN least_id <> page_id THEN least_id END AS refers_to
FROM hashed
"""


@query
def op2_compression_language(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from nearfield.llm import language

    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = language.languages(docs, language.dictionaries(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@query
def op5_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of an id are the outcome of the page with that id: bad if toxic or of low quality."""
    from pyspark.sql import functions as F

    from nearfield.llm import reputation

    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    judged = reputation.judge(table(spark, folder, "pages"), outcomes, RULES)
    numbers = [F.round(name, 6).alias(name) for name in ("rate", "bound")]
    return judged.select("page_id", "host", "path", "rule", "verdict", *numbers)


def _level(name: str, above: str | None) -> str:
    """SQL of one level of shrinkage: units ``name`` (name, parent, n, bad) around the posterior of their parents."""
    mean = f"(SELECT u.*, p.post AS mean FROM {name}s u JOIN {above}_posts p ON u.parent = p.name)" if above else f"{name}s"
    return f"""
{name}_units AS (SELECT * FROM {mean}),
{name}_fit AS (
  SELECT coalesce(1 / least(greatest((sum(n * (bad / n - mean) ** 2) - sum(mean * (1 - mean)))
         / nullif(sum(mean * (1 - mean) * (n - 1)), 0), 1e-4), 0.9) - 1, 1 / 1e-4 - 1) AS strength
  FROM {name}_units WHERE n > 0),
{name}_posts AS (
  SELECT name, n, strength, (bad + strength * mean) / (n + strength) AS post FROM {name}_units, {name}_fit)"""


SQL["op5_host_reputation"] = f"""
WITH urls AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
outcomes AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
counted AS (
  SELECT host AS name, string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') AS labels, count(o.bad) AS n,
         coalesce(sum(o.bad), 0)::BIGINT AS bad FROM urls LEFT JOIN outcomes o ON doc_id = page_id GROUP BY host),
named AS (
  SELECT *, CASE WHEN list_contains({list(LONG_SUFFIXES)}, array_to_string(labels[-2:], '.')) THEN 2 ELSE 1 END AS depth FROM counted),
hosts AS (
  SELECT name, n, bad, array_to_string(labels[-depth:], '.') AS suffix, CASE WHEN regexp_matches(array_to_string(labels, '.'), '^[0-9.]*$|\\]$')
         THEN array_to_string(labels, '.') ELSE array_to_string(labels[-depth - 1:], '.') END AS parent FROM named),
domains AS (
  SELECT parent AS name, suffix AS parent, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixs AS (
  SELECT parent AS name, sum(n) AS n, sum(bad) AS bad,
         (sum(sum(bad)) OVER () + 0.5) / (sum(sum(n)) OVER () + 10.0) AS mean FROM domains GROUP BY parent),
{_level("suffix", None)},
{_level("domain", "suffix")},
{_level("host", "domain")},
rules AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM urls)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN post - 1.645 * sqrt(post * (1 - post) / (n + strength + 1)) > 0.3 THEN 'block' ELSE 'allow' END AS verdict,
  round(post, 6) AS rate, round(post - 1.645 * sqrt(post * (1 - post) / (n + strength + 1)), 6) AS bound
FROM rules JOIN host_posts ON name = host
"""


@query
def op4_warc_members(spark: SparkSession, folder: str) -> DataFrame:
    from nearfield.llm import warc

    return warc.archive(table(spark, folder, "pages"))


@query
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from nearfield.llm import suffixes

    return suffixes.remove_repeats(table(spark, folder, "documents"))


@query
def op1_posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    from nearfield.llm import neighbours

    return neighbours.search(table(spark, folder, "embeddings"), lambda vec_id: vec_id % 100 == 0)


@query
def op13_identity_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers as public

    from nearfield.llm import alignment

    return alignment.align(table(spark, folder, "documents"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))


@query
def op11_dictionary_codes(spark: SparkSession, folder: str) -> DataFrame:
    from nearfield.llm import vector_codes

    codes = vector_codes.encode(table(spark, folder, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _nearest(name: str, books: str) -> str:
    """SQL of the entry of ``books`` (part, entry, place, x) that is nearest to each part of the vectors."""
    return f"""
{name} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, (distance, entry)) AS entry, min(distance) AS distance
  FROM (SELECT vec_id, v.part, entry, sum((v.x - b.x) ** 2)::BIGINT AS distance
        FROM ints v JOIN {books} b ON v.part = b.part AND v.place = b.place GROUP BY ALL) GROUP BY ALL)"""


def _replaced(name: str, books: str, nearest: str) -> str:
    """SQL of the codebooks after a round."""
    return f"""
{name} AS MATERIALIZED (
  SELECT part, entry, place, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM {books} LEFT JOIN (
    SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM ints JOIN {nearest} USING (vec_id, part) GROUP BY ALL)
  USING (part, entry, place))"""


SQL["op11_dictionary_codes"] = f"""
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ints AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(embedding) // 16) AS part, (i - 1) % (len(embedding) // 16) AS place,
         floor(256 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
books0 AS MATERIALIZED (
  SELECT part, rank - 1 AS entry, place, x FROM ints
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
{_nearest("near0", "books0")},{_replaced("books1", "books0", "near0")},
{_nearest("near1", "books1")},{_replaced("books2", "books1", "near1")},
{_nearest("near2", "books2")},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error
  FROM near2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM books2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


@query
def op12_partenum_join(spark: SparkSession, folder: str) -> DataFrame:
    from nearfield.llm import jaccard_join

    return jaccard_join.components(table(spark, folder, "documents"))


SQL["op12_partenum_join"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM docs),
members AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)) AS component_id FROM sets
"""

SQL["op6_suffix_dedup"] = """
WITH docs AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
starts AS MATERIALIZED (
  SELECT r, s, hash(array_slice(b, s + 1, s + 200)) AS mark FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS s FROM docs)),
again AS (SELECT r, s FROM starts WHERE mark IN (SELECT mark FROM starts GROUP BY mark HAVING count(*) > 1)),
runs AS (
  SELECT r, min(s) AS first, max(s) + 200 AS stop FROM (
    SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS run FROM (
      SELECT r, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= 200 THEN 0 ELSE 1 END AS new FROM again))
  GROUP BY r, run),
kept AS (
  SELECT r, count(*) AS spans, sum(stop - first) AS removed, list(first ORDER BY first) AS firsts, list(stop ORDER BY first) AS stops FROM runs GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN spans IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(1, len(firsts) + 2), lambda i:
    hex(array_slice(b, CASE WHEN i = 1 THEN 1 ELSE stops[i - 1] + 1 END, coalesce(firsts[i], octet_length(b))))), '')) END) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
