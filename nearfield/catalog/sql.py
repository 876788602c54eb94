"""What each query of ``nearfield.catalog.queries`` computes, as SQL for DuckDB."""

from __future__ import annotations

from nearfield.functions.text import WHITESPACE

SPACE = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"
SPACE_CLASS = "[" + "".join(f"\\x{{{ord(c):04x}}}" for c in WHITESPACE) + "]"


def _trim(text: str) -> str:
    return f"trim({text}, {SPACE})"


# --- search -------------------------------------------------------------------

METRIC = {
    "cosine": ("list_cosine_similarity", "DESC"),
    "dot": ("list_dot_product", "DESC"),
    "euclid": ("list_distance", "ASC"),
}


def _pairs(points: str = "embeddings", metric: str = "cosine") -> str:
    return (
        f"SELECT q.vec_id AS query_id, p.vec_id AS id, "
        f"{METRIC[metric][0]}(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score "
        f"FROM embeddings q, {points} p"
    )


def _ranked(pairs: str, metric: str = "cosine") -> str:
    return (
        f"SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id "
        f"ORDER BY score {METRIC[metric][1]}, id))::INTEGER AS rank FROM ({pairs})"
    )


def _search(pairs: str, k: int = 10, metric: str = "cosine", where: str = "true", also: str = "", join: str = "") -> str:
    return (
        f"SELECT query_id, rank, r.id AS id, round(score, 6) AS score{also} "
        f"FROM ({_ranked(f'SELECT * FROM ({pairs}) WHERE {where}', metric)}) r {join} WHERE rank <= {k}"
    )


POINTS = (
    "(SELECT e.vec_id, e.embedding, e.label, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM embeddings e "
    "LEFT JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"
)
# The nearest axis is the one of the largest element; of empty cells none is probed.
NEAR_AXES = (
    "SELECT vec_id, axis, row_number() OVER (PARTITION BY vec_id ORDER BY sqrt(greatest(2 - 2 * value + 0.0, 0)), axis) AS place FROM "
    "(SELECT vec_id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) AS axis FROM embeddings) "
    "WHERE axis IN (SELECT DISTINCT arg_max(axis, value) OVER (PARTITION BY vec_id) FROM "
    "(SELECT vec_id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) AS axis FROM embeddings))"
)
LANDMARKS = """
gaps AS MATERIALIZED (
  SELECT p.vec_id, (row_number() OVER (PARTITION BY p.vec_id ORDER BY c.vec_id) - 1) AS cell, list_distance(p.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS gap
  FROM embeddings p, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 64) c),
placed AS MATERIALIZED (SELECT vec_id AS id, arg_min(cell, (gap, cell)) AS cell FROM gaps GROUP BY vec_id),
sizes AS (SELECT cell, count(*) AS n FROM placed GROUP BY cell),
near AS MATERIALIZED (
  SELECT vec_id AS query_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY gap, cell) AS place
  FROM gaps WHERE cell IN (SELECT cell FROM sizes))"""
HOLED = (
    "(SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN (vec_id + i - 1) % 97 = 0 OR (vec_id * 3 + i - 1) % 89 = 0 "
    "THEN 0 ELSE x END) AS embedding FROM embeddings)"
)
FILTERED = f"(SELECT * FROM {POINTS} WHERE lang = 'en' AND n_chars >= 200 AND coalesce(toxic, 0) <> 1)"


def _greedy(first: str, later: str, update: str, k: int = 10, fetch: int = 50, found: str = "SELECT * FROM sim") -> str:
    """One candidate per query and step: ``carry`` sums up its similarity to those picked so far."""
    return f"""
WITH RECURSIVE sim AS MATERIALIZED ({_pairs()}),
cand AS MATERIALIZED (SELECT * FROM ({_ranked(found)}) WHERE rank <= {fetch}),
st AS (
  SELECT query_id, 0 AS step, id, rank, score, NULL::DOUBLE AS carry, NULL::BIGINT AS chosen, NULL::DOUBLE AS value
  FROM cand
  UNION ALL
  SELECT t.query_id, t.step + 1, t.id, t.rank, t.score, {update}, t.pick, t.best
  FROM (
    SELECT *, first_value(id) OVER w AS pick, first_value(standing) OVER w AS best
    FROM (SELECT *, CASE WHEN step = 0 THEN {first} ELSE {later} END AS standing
          FROM st WHERE step < {k} AND (chosen IS NULL OR id <> chosen))
    WINDOW w AS (PARTITION BY query_id ORDER BY standing DESC, rank)
  ) t JOIN sim x ON x.query_id = t.id AND x.id = t.pick
)
SELECT query_id, step AS rank, id, round(score, 6) AS score, round(value, 6) AS mmr_score
FROM st WHERE step >= 1 AND id = chosen"""


# --- chunks -------------------------------------------------------------------


def _fixed_chunks(source: str, tokens: int, percent: int = 15) -> str:
    """Chunks of fixed size of ``source (doc_id, text, ...)``."""
    size = 4 * tokens
    overlap = int(size * (percent / 100))
    stride = size - overlap
    return f"""
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_index) - 1)::INTEGER AS chunk_index,
  start_index, end_index, body AS text, ceil((CASE WHEN n < 50 THEN n ELSE length(body) END) / 4.0)::INTEGER AS tokens
FROM (
  SELECT doc_id, n, s::INTEGER AS start_index, least(s + {size}, n)::INTEGER AS end_index,
    {_trim(f'substring(text, s + 1, {size})')} AS body
  FROM (
    SELECT doc_id, text, length(text) AS n, i * {stride} AS s
    FROM {source}, unnest(generate_series(0, CASE WHEN length(text) <= {size} THEN 0
      ELSE ceil((length(text) - {size}) / {stride}.0)::INTEGER END)) AS g(i)
    WHERE text IS NOT NULL
  )
) WHERE n < 50 OR length(body) >= 50"""


def _sentence_chunks(source: str, size: int = 1600, overlap: int = 240) -> str:
    """Sentence-aware chunks of ``source (doc_id, text)`` as a list of CTEs ending in ``chunk``."""
    gap = f"[.!?]{SPACE_CLASS}+"
    target, high = f"(c.nxt + {size})", f"least(d.n, c.nxt + {size} + d.r)"
    position = f"least(sp.e, {high})"
    distance = f"abs({position} - {target})"
    return f"""
doc AS MATERIALIZED (
  SELECT doc_id, text, length(text) AS n, least(200, floor(length(text) * 0.1)::INTEGER) AS r FROM {source}
  WHERE text IS NOT NULL),
piece AS (
  SELECT doc_id, i, length(p) AS lp, coalesce(length(seps[i]), 0) AS ls
  FROM (SELECT doc_id, string_split_regex(text, '{gap}') AS ps, regexp_extract_all(text, '{gap}') AS seps FROM doc),
    unnest(ps) WITH ORDINALITY AS u(p, i)),
span AS MATERIALIZED (
  SELECT doc_id, e - ls AS s, e
  FROM (SELECT doc_id, i, ls, sum(lp + ls) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM piece)
  WHERE ls > 0),
cut AS (
  SELECT doc_id, NULL::BIGINT AS start, NULL::BIGINT AS stop, 0::BIGINT AS nxt FROM doc WHERE n >= 50
  UNION ALL
  SELECT doc_id, nxt, stop, greatest(nxt + 1, stop - {overlap}) FROM (
    SELECT d.doc_id, c.nxt, CASE WHEN {target} >= any_value(d.n) THEN any_value(d.n)
      ELSE coalesce(arg_min({position}, {distance} * 100000000 + sp.s), {target}) END AS stop
    FROM cut c JOIN doc d ON d.doc_id = c.doc_id
    LEFT JOIN span sp ON sp.doc_id = c.doc_id AND {target} < d.n AND sp.s >= greatest(0, {target} - d.r)
      AND sp.s + 1 < {high} AND {distance} < least(d.r, {0.3 * size})
    WHERE coalesce(c.stop, -1) < d.n
    GROUP BY d.doc_id, c.nxt)),
body AS (
  SELECT doc_id, start, stop, {_trim('substring(text, start + 1, stop - start)')} AS text, false AS short
  FROM cut JOIN doc USING (doc_id) WHERE start IS NOT NULL
  UNION ALL
  SELECT doc_id, 0, n, {_trim('text')}, true FROM doc WHERE n < 50),
chunk AS MATERIALIZED (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INTEGER AS chunk_index,
    start::INTEGER AS start_index, stop::INTEGER AS end_index, text,
    ceil((CASE WHEN short THEN stop ELSE length(text) END) / 4.0)::INTEGER AS tokens
  FROM body WHERE short OR length(text) >= 50)"""


def _with_chunks(source: str, rest: str, more: str = "") -> str:
    return f"WITH RECURSIVE {_sentence_chunks(source)}{more} {rest}"


def _chunk_uuid(options: str) -> str:
    digest = f"md5(concat_ws('|', doc_id, chunk_index, start_index, '{options}'))"
    return (
        f"concat(substr({digest}, 1, 8), '-', substr({digest}, 9, 4), '-3', substr({digest}, 14, 3), "
        f"'-a', substr({digest}, 18, 3), '-', substr({digest}, 21, 12))"
    )


def _weights(source: str, keys: str) -> str:
    """Non-zero word counts by bucket of ``source (keys, text)``."""
    return (
        f"SELECT {keys}, bucket, sum(sign)::DOUBLE AS weight FROM ("
        f"SELECT {keys}, (('0x' || substr(md5(word), 1, 8))::BIGINT % 64)::INTEGER AS bucket, "
        f"CASE WHEN substr(md5(word), 9, 1) < '8' THEN 1 ELSE -1 END AS sign "
        f"FROM (SELECT {keys}, unnest(string_split_regex(lower(text), '[ \\t\\n\\x0b\\f\\r]+')) AS word FROM {source}) "
        f"WHERE word <> '') GROUP BY ALL HAVING sum(sign) <> 0"
    )


def _text_hits(k: int) -> str:
    """CTEs for text search over chunks, ending in ``hit (query_id, rank, id, score, text, source)``."""
    return f""",
point AS MATERIALIZED (SELECT {_chunk_uuid('400/15/1/50')} AS id, doc_id, chunk_index, text FROM chunk),
pw AS MATERIALIZED ({_weights('point', 'id')}),
qw AS MATERIALIZED ({_weights('(SELECT item_id AS query_id, text FROM benchmark)', 'query_id')}),
pn AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM pw GROUP BY id),
qn AS (SELECT query_id, sqrt(sum(weight * weight)) AS norm FROM qw GROUP BY query_id),
prod AS (SELECT query_id, id, sum(p.weight * q.weight) AS dot FROM pw p JOIN qw q USING (bucket) GROUP BY ALL),
score AS (
  SELECT q.item_id AS query_id, p.id,
    CASE WHEN pn.norm * qn.norm > 0 THEN coalesce(dot, 0) / (pn.norm * qn.norm) ELSE 0 END AS score
  FROM benchmark q CROSS JOIN point p LEFT JOIN prod ON prod.query_id = q.item_id AND prod.id = p.id
  LEFT JOIN pn ON pn.id = p.id LEFT JOIN qn ON qn.query_id = q.item_id),
hit AS (SELECT r.*, p.text, d.source FROM ({_ranked('SELECT * FROM score')}) r JOIN point p USING (id)
  JOIN documents d USING (doc_id) WHERE rank <= {k})"""


# --- other inputs ---------------------------------------------------------------

LABELLED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
SYNC_SOURCE = (
    "(SELECT d.doc_id, d.lang, d.n_chars, e.embedding, CASE WHEN d.toxic = 1 THEN NULL WHEN d.quality = 0 THEN '' "
    f"ELSE d.text END AS text FROM {LABELLED} d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"
)
SHEET = "(SELECT row_number() OVER () AS doc_id, concat('role: ', role, chr(10), 'text: ', text) AS text FROM conversations)"
LAST_TURN = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) WHERE age = 1)"
TO_SYNC = f"(SELECT * FROM {SYNC_SOURCE} WHERE text <> '')"
REFUSED = "contains(text, 'stupid')"
SETTLED = f"doc_id NOT IN (SELECT doc_id FROM chunk WHERE {REFUSED})"
EVENT = """(
SELECT event_id, ts, user_id AS doc_id, event_type,
  CASE event_type WHEN 'signup' THEN 'insert' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'update'
    WHEN 'error' THEN 'delete' ELSE event_type END AS op,
  NOT (event_type = 'error' OR (event_type = 'click' AND value < 3)) AS has_document,
  CASE WHEN event_type = 'purchase' AND value < 5 THEN NULL ELSE concat_ws(' ', 'event', event_type, 'of user', user_id,
    'worth', round(value * 100)::BIGINT, props) END AS text
FROM events)"""
CLASSIFIED = f"""(
SELECT *, CASE WHEN op NOT IN ('insert', 'update', 'delete') OR doc_id IS NULL THEN 'ignore' WHEN op = 'delete' THEN 'delete'
  WHEN NOT has_document THEN 'ignore' WHEN length(text) > 0 THEN 'upsert' ELSE 'delete' END AS action
FROM {EVENT})"""
EFFECTIVE = f"""(
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS age
  FROM {CLASSIFIED} WHERE action <> 'ignore') WHERE age = 1)"""


def _changed(kept: str) -> str:
    fields = "doc_id, chunk_index, start_index, end_index, tokens, text, category"
    return _with_chunks(
        f"(SELECT doc_id, text FROM {EFFECTIVE} WHERE action = 'upsert')",
        f"SELECT {fields} FROM chunk JOIN (SELECT doc_id, event_type AS category FROM {EFFECTIVE}) USING (doc_id) {kept}",
    )


KEPT_CHUNKS = f"""UNION ALL
SELECT doc_id, chunk_index, start_index, end_index, tokens, f.text, d.lang FROM ({_fixed_chunks('documents', 400)}) f
JOIN documents d USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM {EFFECTIVE})"""

FILTERS = {
    "filter_match": "lang = 'en'",
    "filter_range": "n_chars >= 500 AND n_chars < 3000",
    "filter_compound": "lang = 'en' AND n_chars >= 200 AND (coalesce(quality = 1, false) OR source = 'src3') "
    "AND NOT coalesce(toxic = 1, false)",
    "filter_in": "source IN ('src1', 'src7', 'src14')",
    "filter_not_in": "NOT coalesce(quality IN (0), false)",
    "filter_metadata": "lang = 'fr' AND quality = 1",
    "filter_doc_id": "doc_id = 7",
    "filter_exclude_docs": "doc_id NOT IN (1, 2, 3)",
    "filter_combine_and": "lang = 'en' AND n_chars >= 1000 AND NOT coalesce(toxic = 1, false)",
    "filter_combine_or": "(lang = 'fr' OR n_chars >= 5000) AND NOT coalesce(quality = 0, false)",
}
CHUNK_FIELDS = "doc_id, chunk_index, start_index, end_index, text, tokens"
SPAN_FIELDS = "doc_id, chunk_index, start_index, end_index, tokens"
ROUGH = (
    "concat(' ', chr(9), chr(10), replace(replace(text, '. ', concat('.', chr(13), chr(10), chr(13), chr(10), chr(13), chr(10), "
    "chr(13), chr(10), chr(9), ' ')), ', ', concat(',', chr(13), ' ', chr(9))), chr(13), chr(10), chr(13))"
)


def _clean(text: str) -> str:
    unix = f"regexp_replace({text}, '\\r\\n?', chr(10), 'g')"
    spaced = f"regexp_replace({unix}, '\\n{{3,}}', concat(chr(10), chr(10)), 'g')"
    return _trim(f"regexp_replace({spaced}, '[ \\t]+', ' ', 'g')")


SQL: dict[str, str] = {
    "search_cosine": _search(_pairs()),
    "search_blocked": _search(_pairs()),
    "search_ann": _search(_pairs()),
    "search_ann_probes": _search(
        f"SELECT c.* FROM ({_pairs(metric='euclid')}) c JOIN ({NEAR_AXES}) a ON a.vec_id = c.query_id "
        f"JOIN ({NEAR_AXES}) b ON b.vec_id = c.id AND b.place = 1 AND b.axis = a.axis WHERE a.place <= 3",
        metric="euclid",
    ),
    **{
        f"search_holed_{metric}": _search(_pairs(HOLED, metric).replace("FROM embeddings q", f"FROM {HOLED} q"), metric=metric)
        for metric in METRIC
    },
    "index_recall": f"""
WITH {LANDMARKS},
asked AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 5 = 0 ORDER BY vec_id LIMIT 1000),
hits AS (SELECT query_id, id FROM ({_ranked(_pairs(metric="euclid"), "euclid")}) JOIN asked USING (query_id) WHERE rank <= 10),
found AS (SELECT place, count(*) AS n FROM hits JOIN placed USING (id) JOIN near USING (query_id, cell) GROUP BY place),
reads AS (SELECT place, avg(n) AS n FROM near JOIN sizes USING (cell) JOIN asked USING (query_id) GROUP BY place)
SELECT place::INTEGER AS probes,
  round(sum(coalesce(f.n, 0)) OVER upto / (SELECT count(*) FROM hits), 6)::DOUBLE AS recall,
  round(sum(r.n) OVER upto / (SELECT count(*) FROM embeddings), 6)::DOUBLE AS points_read
FROM reads r LEFT JOIN found f USING (place) WINDOW upto AS (ORDER BY place)""",
    "search_index_filtered": f"""
WITH {LANDMARKS},
passed AS (SELECT vec_id AS id FROM {FILTERED}),
held AS (SELECT cell, count(*) AS n FROM placed JOIN passed USING (id) GROUP BY cell),
ordered AS (
  SELECT query_id, cell, row_number() OVER w AS place, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM near JOIN held USING (cell) WINDOW w AS (PARTITION BY query_id ORDER BY place)),
wanted AS (SELECT query_id, cell FROM ordered WHERE place <= 2 OR before < 10)
SELECT query_id, rank, id, round(score, 6) AS score FROM ({_ranked(
        "SELECT p.* FROM (" + _pairs(metric="euclid") + ") p JOIN placed USING (id) JOIN passed USING (id) JOIN wanted USING (query_id, cell)", "euclid"
    )}) WHERE rank <= 10""",
    "search_dot": _search(_pairs(metric="dot"), metric="dot"),
    "search_euclid": _search(_pairs(metric="euclid"), metric="euclid"),
    "search_threshold": _search(_pairs(), where="score >= 0.3"),
    "search_filtered": _search(_pairs(FILTERED)),
    "search_filtered_variant": _search(_pairs(FILTERED)),
    "search_projection": _search(
        _pairs(POINTS), also=", lang, source, label", join=f"JOIN {POINTS} p ON p.vec_id = r.id"
    ),
    "search_text": _with_chunks(
        "documents", "SELECT query_id, rank, id, round(score, 6) AS score FROM hit", _text_hits(10)
    ),
    "assemble_context": _with_chunks(
        "documents",
        "SELECT query_id, string_agg(text, concat(chr(10), chr(10)) ORDER BY rank) AS context, "
        "string_agg(concat(id, ':', source), ',' ORDER BY rank) AS sources, round(sum(score), 6) AS score_sum "
        "FROM hit GROUP BY query_id",
        _text_hits(3),
    ),
    "mmr": _greedy(
        "0.7 * score", "0.7 * score - 0.3 * carry", "greatest(coalesce(t.carry, -1), x.score)"
    ),
    "diversity": _greedy(
        "CASE WHEN rank = 1 THEN score ELSE -9 END",
        "0.7 * score - 0.3 * carry / step",
        "coalesce(t.carry, 0) + x.score",
    ),
    "query_request": f"SELECT r.*, lang, source FROM ("
    + _greedy(
        "0.7 * score", "0.7 * score - 0.3 * carry", "greatest(coalesce(t.carry, -1), x.score)", 5, 20,
        f"SELECT * FROM ({_pairs(FILTERED)}) WHERE score >= 0.1",
    )
    + f") r JOIN {POINTS} p ON p.vec_id = r.id",
    "query_with_vectors": f"SELECT r.*, lang, source, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM ("
    + _greedy(
        "0.7 * score", "0.7 * score - 0.3 * carry", "greatest(coalesce(t.carry, -1), x.score)", 5, 20,
        f"SELECT * FROM ({_pairs(FILTERED)}) WHERE score >= 0.1",
    )
    + f") r JOIN {POINTS} p ON p.vec_id = r.id",
    "query_flags": f"SELECT vec_id AS query_id, 5 AS top_k, least(coalesce(n, 0), 5) AS actual_k, coalesce(n, 0) > 0 AS mmr_applied, "
    f"false AS diversity_applied FROM embeddings LEFT JOIN (SELECT query_id, count(*) AS n FROM "
    f"({_pairs('(SELECT * FROM embeddings WHERE label >= 5)')}) WHERE score >= 0.35 GROUP BY 1) ON query_id = vec_id",
    "pairwise_cosine": "SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) "
    "AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1",
    "check_dims": "SELECT vec_id AS id, 32::INTEGER AS dim FROM embeddings WHERE label = 3",
    "points_info": "SELECT count(*) AS points, min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim "
    "FROM embeddings",
    "upsert_points": "SELECT vec_id AS id, (CASE WHEN label <= 2 THEN label + 200 WHEN label <= 4 THEN label + 100 ELSE label END)"
    "::INTEGER AS label, len(embedding)::INTEGER AS dim FROM embeddings UNION ALL "
    "SELECT vec_id + 1000000, label, len(embedding)::INTEGER FROM embeddings WHERE label = 7",
    "delete_ids": "SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "delete_doc": f"SELECT {SPAN_FIELDS} FROM ({_fixed_chunks('documents', 400)}) WHERE doc_id <> 7",
    "delete_filter": f"SELECT vec_id AS id, label, coalesce(quality, -1) AS quality FROM {POINTS} WHERE NOT coalesce(quality = 0, false)",
    "delete_filter_variant": f"SELECT vec_id AS id, label, coalesce(quality, -1) AS quality FROM {POINTS} WHERE NOT coalesce(quality = 0, false)",
    "replace_by_doc": f"SELECT {SPAN_FIELDS} FROM ({_fixed_chunks('documents', 400)}) WHERE doc_id NOT IN "
    f"(SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT {SPAN_FIELDS} FROM ({_fixed_chunks('documents', 200)}) "
    "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    **{
        name: f"SELECT doc_id, lang, source, n_chars, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM {LABELLED} WHERE {condition}"
        for name, condition in FILTERS.items()
    },
    "token_estimate": "SELECT doc_id, ceil(length(text) / 4.0)::INTEGER AS tokens FROM documents",
    "validate_text": f"SELECT doc_id, reason IS NULL AS valid, reason FROM (SELECT doc_id, CASE WHEN length({_trim('text')}) = 0 "
    "THEN 'Text is empty' WHEN ceil(length(text) / 4.0) > 1000 THEN concat('Text too long: ~', "
    "ceil(length(text) / 4.0)::INTEGER, ' tokens (max: 1000)') END AS reason FROM documents)",
    "split_sentences": "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS sentence_index, "
    f"sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){SPACE_CLASS}+', concat('\\1', chr(1)), 'g'), "
    f"chr(1)) AS parts FROM documents), unnest(parts) WITH ORDINALITY AS u(sentence, i) WHERE length({_trim('sentence')}) > 0",
    "clean_text": f"SELECT doc_id, {_clean(ROUGH)} AS cleaned FROM documents",
    "chunk_fixed": f"SELECT {CHUNK_FIELDS} FROM ({_fixed_chunks('documents', 100)})",
    "chunk_sentence": _with_chunks("documents", f"SELECT {CHUNK_FIELDS} FROM chunk"),
    "chunk_ids": f"SELECT doc_id, chunk_index, {_chunk_uuid('400/15/0/50')} AS chunk_id FROM ({_fixed_chunks('documents', 400)})",
    "chunk_stats": _with_chunks(
        "documents",
        "SELECT lang, count(*) AS chunks, round(avg(length(c.text)), 6) AS avg_chunk_chars FROM chunk c "
        "JOIN documents d USING (doc_id) GROUP BY lang",
    ),
    "embed_chunks": _with_chunks(
        "documents",
        "SELECT doc_id, chunk_index, bucket, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id, chunk_index)), 6) "
        "AS weight FROM w",
        f", w AS ({_weights('chunk', 'doc_id, chunk_index')})",
    ),
    "embed_summary": _with_chunks(
        f"(SELECT * FROM documents WHERE length({_trim('text')}) > 0)",
        "SELECT count(*) AS total_chunks, sum(tokens)::BIGINT AS total_tokens, 64::INTEGER AS embedding_dimensions FROM chunk",
    ),
    "csv_to_text": "SELECT row_number() OVER (ORDER BY c_custkey) AS row_number, concat('Row ', row_number() OVER (ORDER BY "
    "c_custkey), ': c_custkey: ', c_custkey, ', c_name: ', c_name, ', c_nationkey: ', c_nationkey, ', c_acctbal: ', c_acctbal, "
    "', c_mktsegment: ', c_mktsegment) AS line FROM customer",
    "csv_from_files": "SELECT row_number() OVER (ORDER BY c_custkey) AS row_number, concat('Row ', row_number() OVER (ORDER BY "
    "c_custkey), ': c_custkey: ', c_custkey, ', c_name: ', c_name, ', c_nationkey: ', c_nationkey, ', c_acctbal: ', c_acctbal, "
    "', c_mktsegment: ', c_mktsegment) AS line FROM customer",
    "extract_files": f"SELECT filename, size, type, CASE WHEN reason IS NULL THEN {_clean('html')} END AS content, reason FROM ("
    "SELECT concat(page_id, '-', url) AS filename, octet_length(encode(html))::BIGINT AS size, "
    "lower(list_extract(string_split(concat(page_id, '-', url), '.'), -1)) AS type, html, "
    f"CASE WHEN length({_trim('html')}) = 0 THEN 'No readable content found in file' END AS reason FROM pages)",
    "sheet_rows": "SELECT concat('sheet_talks_', conv_id) AS doc_id, conv_id::VARCHAR AS row_key, concat('role: ', "
    "coalesce(role, ''), chr(10), 'text: ', coalesce(text, '')) AS text, nullif(turn::VARCHAR, '') AS turn FROM "
    + LAST_TURN,
    "sheet_points": _with_chunks(
        f"(SELECT concat('sheet_talks_', conv_id) AS doc_id, concat('role: ', role, chr(10), 'text: ', text) AS text FROM {LAST_TURN})",
        f"SELECT {_chunk_uuid('400/15/1/50')} AS id, doc_id, 'google_sheets' AS source, 'talks' AS sheet_name, "
        "conv_id::VARCHAR AS row_key, turn::VARCHAR AS turn, chunk_index, c.text, 64::INTEGER AS dim FROM chunk c "
        f"JOIN (SELECT conv_id, turn, concat('sheet_talks_', conv_id) AS doc_id FROM {LAST_TURN}) USING (doc_id)",
    ),
    "sync_points": _with_chunks(
        f"(SELECT * FROM {SYNC_SOURCE} WHERE text <> '')",
        f"SELECT {_chunk_uuid('400/15/1/50')} AS id, doc_id, 'mongo' AS source, lang, chunk_index, start_index, end_index, "
        "tokens, 64::INTEGER AS dim FROM chunk JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)",
    ),
    "sheet_preview": "SELECT conv_id, turn, role, text, (SELECT count(*) FROM conversations) AS total_rows, "
    "'role, text' AS column_names FROM conversations ORDER BY conv_id, turn LIMIT 3",
    "sheet_sync_stats": _with_chunks(
        SHEET,
        "SELECT (SELECT count(*) FROM conversations) AS total_rows, (SELECT count(*) FROM conversations) AS processed_rows, "
        "count(*) AS new_chunks, 0::BIGINT AS updated_chunks, 0::BIGINT AS errors FROM chunk",
    ),
    "scan_missing_embedding": f"SELECT doc_id, lang, n_chars FROM {SYNC_SOURCE} WHERE embedding IS NULL",
    "source_status": "SELECT count(*) AS total_documents, count(embedding) AS documents_with_embeddings, "
    f"count(*) - count(embedding) AS documents_without_embeddings FROM {SYNC_SOURCE}",
    "sync_eligibility": "SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'skip_no_text' WHEN embedding IS NOT NULL "
    f"THEN 'skip_embedded' ELSE 'process' END AS action FROM {SYNC_SOURCE}",
    "sync_preview": _with_chunks(
        f"(SELECT * FROM {SYNC_SOURCE} WHERE text <> '')",
        "SELECT s.doc_id, coalesce(n, 0)::INTEGER AS chunks, embedding IS NOT NULL AS has_embedding, "
        f"length(text)::INTEGER AS text_length FROM {SYNC_SOURCE} s LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunk "
        "GROUP BY doc_id) USING (doc_id) WHERE text <> ''",
    ),
    "sync_stats": _with_chunks(
        f"(SELECT * FROM {SYNC_SOURCE} WHERE text <> '' AND embedding IS NULL)",
        f"SELECT (SELECT count(*) FROM doc) AS documents_processed, count(*) AS chunks_created, count(*) AS points_upserted, "
        f"(SELECT count(*) FROM {SYNC_SOURCE}) - (SELECT count(*) FROM doc) AS documents_skipped FROM chunk",
    ),
    "sync_run": _with_chunks(
        TO_SYNC,
        f"SELECT (SELECT count(*) FROM doc) - (SELECT count(DISTINCT doc_id) FROM chunk WHERE {REFUSED}) AS documents_processed, "
        f"(SELECT count(*) FROM chunk WHERE {SETTLED}) AS chunks_created, (SELECT count(*) FROM chunk WHERE {SETTLED}) AS points_upserted, "
        f"(SELECT count(*) FROM {SYNC_SOURCE}) - (SELECT count(*) FROM doc) AS documents_skipped, "
        f"(SELECT count(DISTINCT doc_id) FROM chunk WHERE {REFUSED}) AS errors",
    ),
    "sync_errors": _with_chunks(TO_SYNC, f"SELECT DISTINCT doc_id, 'text refused' AS error FROM chunk WHERE {REFUSED}"),
    "sync_written": _with_chunks(
        TO_SYNC,
        f"SELECT {_chunk_uuid('400/15/1/50')} AS id, doc_id, lang, chunk_index, coalesce(weight, 0.0) AS weight FROM chunk "
        "JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) LEFT JOIN (SELECT doc_id, chunk_index, sum(abs(weight)) AS weight "
        f"FROM ({_weights('chunk', 'doc_id, chunk_index')}) GROUP BY 1, 2) USING (doc_id, chunk_index) WHERE {SETTLED} "
        "UNION ALL SELECT concat('old-', doc_id), doc_id, lang, -1, 64.0 FROM documents WHERE doc_id NOT IN "
        f"(SELECT doc_id FROM chunk WHERE {SETTLED})",
    ),
    "sheet_sync_errors": _with_chunks(
        f"(SELECT conv_id AS doc_id, concat('role: ', role, chr(10), 'text: ', text) AS text FROM {LAST_TURN})",
        "SELECT (SELECT count(*) FROM doc) AS total_rows, (SELECT count(*) FROM doc) - count(DISTINCT doc_id) FILTER "
        f"({REFUSED}) AS processed_rows, count(*) FILTER ({SETTLED}) AS new_chunks, 0::BIGINT AS updated_chunks, "
        f"count(DISTINCT doc_id) FILTER ({REFUSED}) AS errors FROM chunk",
    ),
    "points_table": "SELECT vec_id AS id, vec_id % 50 AS doc_id, CASE WHEN vec_id % 50 = 9 THEN 99 ELSE label END AS label, "
    "round(CASE WHEN label <= 2 AND vec_id % 50 <> 9 THEN 2 ELSE 1 END * list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings "
    "WHERE CASE WHEN vec_id % 50 = 9 THEN vec_id < 200 ELSE vec_id % 11 <> 0 AND vec_id % 50 <> 7 AND label <> 5 END",
    "compose_payload": "SELECT doc_id, coalesce(CASE WHEN lang <> 'de' THEN source END, 'mongo') AS source, "
    f"'2024-01-01T00:00:00.000Z' AS synced_at, lang, coalesce(quality, -1) AS quality FROM {LABELLED}",
    "cdc_classify": f"SELECT event_id, doc_id, op, action FROM {CLASSIFIED}",
    "cdc_apply": _changed(KEPT_CHUNKS),
    "cdc_stream": _changed(""),
    "cdc_compacted": _changed(""),
    "cdc_recovered": _changed(""),
    "sheet_stream": _with_chunks(
        f"(SELECT concat('sheet_talks_', conv_id) AS doc_id, concat('role: ', role, chr(10), 'text: ', text) AS text FROM {LAST_TURN})",
        "SELECT doc_id, chunk_index, c.text, turn::VARCHAR AS turn FROM chunk c "
        f"JOIN (SELECT turn, concat('sheet_talks_', conv_id) AS doc_id FROM {LAST_TURN}) USING (doc_id)",
    ),
    "sync_points_fixed": f"SELECT {SPAN_FIELDS} FROM ({_fixed_chunks(TO_SYNC, 400)})",
    "delete_dispatch": "SELECT 'all' AS request, 'ids' AS deleted_by, count(*) AS deleted FROM embeddings WHERE vec_id IN (1, 2, 3) "
    "UNION ALL SELECT 'document', 'doc_id', count(*) FROM embeddings WHERE vec_id % 50 = 7 "
    "UNION ALL SELECT 'filter', 'filter', count(*) FROM embeddings WHERE label = 5",
    "ensure_dataset": "SELECT count(*) AS points, 64::INTEGER AS dim, 'euclid' AS metric, true AS made, false AS again FROM embeddings",
    "extract_kinds": "SELECT concat('p', page_id, ['.csv', '.txt', '.md', '.pdf'][page_id % 4 + 1]) AS filename, "
    "['csv', 'txt', 'md', 'pdf'][page_id % 4 + 1] AS type, CASE page_id % 4 WHEN 0 THEN concat('Row 1: id: ', page_id, ', url: ', url, "
    f"', column_3: more') WHEN 1 THEN {_clean('html')} END AS content, CASE page_id % 4 WHEN 0 THEN 1 ELSE -1 END AS row_count, "
    "CASE page_id % 4 WHEN 2 THEN 'No readable content found in file' WHEN 3 THEN 'No parser for pdf' END AS reason FROM pages",
}
SQL["query_index_filtered"] = SQL["query_request"]  # all cells probed: exact
TWICE = "(SELECT doc_id, lang, CASE WHEN doc_id % 10 = 0 THEN text || ' changed again' ELSE text END AS text FROM documents)"
SQL["sync_incremental"] = _with_chunks(
    TWICE,
    f"SELECT {_chunk_uuid('400/15/1/50')} AS id, doc_id, lang, chunk_index, CASE WHEN doc_id % 10 IN (0, 3) THEN 'second' ELSE 'first' END "
    "AS synced_at, coalesce(weight, 0.0) AS weight FROM chunk JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) LEFT JOIN "
    f"(SELECT doc_id, chunk_index, sum(abs(weight)) AS weight FROM ({_weights('chunk', 'doc_id, chunk_index')}) GROUP BY 1, 2) "
    "USING (doc_id, chunk_index) WHERE doc_id % 10 NOT IN (1, 2)",
)
SQL["sync_incremental_stats"] = _with_chunks(
    TWICE,
    """, later AS (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN repeat(' ', 80) ELSE text END AS text FROM doc WHERE doc_id % 10 <> 1),
  same AS (SELECT count(DISTINCT doc_id) AS n FROM chunk WHERE doc_id % 10 > 3)
SELECT (SELECT count(*) FROM later WHERE length(text) > 0) - n AS documents_processed,
  (SELECT count(*) FROM chunk WHERE doc_id % 10 IN (0, 3)) AS chunks_created, (SELECT count(*) FROM chunk WHERE doc_id % 10 IN (0, 3)) AS points_upserted,
  (SELECT count(*) FROM later WHERE coalesce(length(text), 0) = 0) AS documents_skipped, 0::BIGINT AS errors, n AS documents_unchanged,
  (SELECT count(DISTINCT doc_id) FROM chunk WHERE doc_id % 10 = 1) AS documents_dropped FROM same""",
)
SQL["embed_cached"] = SQL["embed_chunks"]
SQL["embed_cache_runs"] = _with_chunks(
    "documents",
    ", seen AS (SELECT count(DISTINCT text) AS texts, count(DISTINCT text) FILTER (doc_id % 2 = 1) AS odd FROM chunk) "
    "SELECT 1 AS run, odd AS texts FROM seen UNION ALL SELECT 2, texts - odd FROM seen UNION ALL SELECT 3, 0 FROM seen",
)
SQL["search_filtered_shredded"] = SQL["search_filtered"]
