"""One query per operator over the given tables; ``nearfield.catalog.sql`` says the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.catalog import inputs as given
from nearfield.functions import filters as flt
from nearfield.functions import text as tx
from nearfield.functions.vectors import cosine
from nearfield.operators.chunking import chunk_documents, chunk_stats, split_sentences, with_chunk_count
from nearfield.operators.context import assemble_context
from nearfield.operators.embedding import EmbeddingCache, embed_summary, embed_texts, provider_factory
from nearfield.operators.index import build_index, fit_recall, search_index
from nearfield.operators.points import check_dims, delete_points, points_info, replace_docs, upsert_points
from nearfield.operators.search import search
from nearfield.plans.ingest import (
    ChunkOptions,
    compose_payload,
    run_sync,
    settle,
    sync_action,
    sync_points,
    sync_preview,
    sync_sheet,
    sync_stats,
)
from nearfield.plans.query import QueryOptions, query_summary, query_vectors, run_queries
from nearfield.session import scratch_path, stored
from nearfield.sources.files import csv_lines, extract_files, read_csv_rows
from nearfield.sources.rows import number_rows
from nearfield.sources.sheets import sheet_cells, sheet_documents, sheet_preview, sheet_sync_stats
from nearfield.sources.tables import PointTable, scan_documents, source_status
from nearfield.streaming.changes import ChangeLog, ChangeSettings, apply_changes, classify_changes, follow_sheet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HASHING = provider_factory("hashing", dimensions=64)
COUNTING = provider_factory("hashing", dimensions=64, normalize=False)  # whole numbers: sums are exact


def query(name: str) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return add


def _shown(name: str):
    """A label in a result: -1 where there is none, as integers with gaps compare badly across engines."""
    return F.coalesce(name, F.lit(-1)).alias(name)


# --- search -------------------------------------------------------------------


def _hits(hits: DataFrame, *also: str) -> DataFrame:
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"), *also)


@query("search_cosine")
def search_cosine(spark, folder):
    return _hits(search(given.vectors(spark, folder), given.vector_queries(spark, folder), 10))


@query("search_dot")
def search_dot(spark, folder):
    return _hits(search(given.vectors(spark, folder), given.vector_queries(spark, folder), 10, metric="dot"))


@query("search_euclid")
def search_euclid(spark, folder):
    return _hits(search(given.vectors(spark, folder), given.vector_queries(spark, folder), 10, metric="euclid"))


@query("search_threshold")
def search_threshold(spark, folder):
    return _hits(search(given.vectors(spark, folder), given.vector_queries(spark, folder), 10, threshold=0.3))


@query("search_blocked")
def search_blocked(spark, folder):
    """More queries than go to every task: blocks of them meet blocks of points."""
    return _hits(search(given.vectors(spark, folder), given.vector_queries(spark, folder), 10, broadcast_rows=200))


@query("search_ann")
def search_ann(spark, folder):
    """Cell index, all cells probed."""
    path = scratch_path(spark, "index")
    build_index(given.vectors(spark, folder), path, cells=16)
    return _hits(search_index(spark, path, given.vector_queries(spark, folder), 10, probes=None))


@query("search_ann_probes")
def search_ann_probes(spark, folder):
    """Cells around given centres (the axes), the three nearest probed, queries in several batches."""
    path = scratch_path(spark, "index")
    build_index(given.vectors(spark, folder), path, cells=64, metric="euclid", centres=np.eye(64))
    queries = given.vector_queries(spark, folder)
    return _hits(search_index(spark, path, queries, 10, probes=3, broadcast_rows=300))


def _landmark_index(spark, folder, keep: list[str]) -> str:
    """Cells around the 64 vectors of the smallest ids."""
    path = scratch_path(spark, "index")
    points = given.points(spark, folder)
    chosen = points.select("id", "vector").orderBy("id").limit(64).collect()
    build_index(points, path, cells=len(chosen), metric="euclid", keep=keep, centres=np.array([r.vector for r in chosen], float))
    return path


@query("index_recall")
def index_recall(spark, folder):
    """What each number of probes finds of the ten best of every fifth vector, and the share of points it reads."""
    queries = given.vector_queries(spark, folder).where("query_id % 5 = 0").orderBy("query_id").limit(1000)
    measured = fit_recall(spark, _landmark_index(spark, folder, []), 10, queries=queries)
    return measured.select("probes", F.round("recall", 6).alias("recall"), F.round("points_read", 6).alias("points_read"))


@query("search_index_filtered")
def search_index_filtered(spark, folder):
    """Two cells, and further ones until ten points pass the filter; queries are sent to their cells."""
    path = _landmark_index(spark, folder, ["lang", "n_chars", "toxic"])
    return _hits(search_index(spark, path, given.vector_queries(spark, folder), 10, probes=2, where=SEARCH_FILTER, broadcast_rows=100))


@query("query_index_filtered")
def query_index_filtered(spark, folder):
    """Filter, threshold, MMR and payload in one request on a fitted index, all cells probed."""
    path = scratch_path(spark, "index")
    build_index(given.points(spark, folder), path, cells=16, keep=["lang", "source", "n_chars", "toxic"])
    options = QueryOptions(
        top_k=5, fetch_k=20, where=SEARCH_FILTER, threshold=0.1, mmr=True, mmr_lambda=0.7, payload=["lang", "source"], probes=None
    )
    hits = run_queries(None, given.vector_queries(spark, folder), options, index=path)
    return _hits(hits, F.round("mmr_score", 6).alias("mmr_score"), "lang", "source")


def _holed(vectors: DataFrame) -> DataFrame:
    """Vectors of which some elements are missing or not a number."""
    element = lambda x, i: F.when((F.col("id") + i) % 97 == 0, F.lit(None)).when((F.col("id") * 3 + i) % 89 == 0, float("nan")).otherwise(x)
    return vectors.withColumn("vector", F.transform("vector", element))


def _search_holed(metric: str) -> Query:
    def run(spark, folder):
        points = _holed(given.vectors(spark, folder))
        return _hits(search(points, points.select(F.col("id").alias("query_id"), "vector"), 10, metric=metric))

    return run


QUERIES.update({f"search_holed_{metric}": _search_holed(metric) for metric in ("cosine", "dot", "euclid")})


SEARCH_FILTER = {
    "must": [{"key": "lang", "match": {"value": "en"}}, {"key": "n_chars", "range": {"gte": 200}}],
    "must_not": [{"key": "toxic", "match": {"value": 1}}],
}


@query("search_filtered")
def search_filtered(spark, folder):
    options = QueryOptions(where=SEARCH_FILTER)
    return _hits(run_queries(given.points(spark, folder), given.vector_queries(spark, folder), options))


@query("search_projection")
def search_projection(spark, folder):
    options = QueryOptions(payload=["lang", "source", "label"])
    hits = run_queries(given.points(spark, folder), given.vector_queries(spark, folder), options)
    return _hits(hits, "lang", "source", "label")


def _embedded_chunks(spark, folder) -> DataFrame:
    chunks = chunk_documents(given.documents(spark, folder), keep=["source"])
    return embed_texts(chunks, COUNTING, share_copies=True).withColumnRenamed("chunk_id", "id")


@query("search_text")
def search_text(spark, folder):
    queries = query_vectors(given.text_queries(spark, folder), COUNTING)
    return _hits(run_queries(_embedded_chunks(spark, folder), queries))


@query("assemble_context")
def assemble_contexts(spark, folder):
    points = stored(_embedded_chunks(spark, folder), "chunks")
    queries = query_vectors(given.text_queries(spark, folder), COUNTING)
    hits = run_queries(points, queries, QueryOptions(top_k=3, payload=["text", "source"]))
    contexts = assemble_context(hits, title="source")
    return contexts.select(
        "query_id",
        "context",
        F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["id"], s["title"])), ",").alias("sources"),
        F.round(F.aggregate("sources", F.lit(0.0), lambda t, s: t + s["score"]), 6).alias("score_sum"),
    )



# --- re-ranking ---------------------------------------------------------------


def _reranked(spark, folder, options: QueryOptions) -> DataFrame:
    hits = run_queries(given.vectors(spark, folder), given.vector_queries(spark, folder), options)
    return _hits(hits, F.round("mmr_score", 6).alias("mmr_score"))


@query("mmr")
def mmr(spark, folder):
    # A stored vector as its own query makes lambda 0.5 tie everywhere.
    return _reranked(spark, folder, QueryOptions(top_k=10, fetch_k=50, mmr=True, mmr_lambda=0.7))


@query("diversity")
def diversity(spark, folder):
    return _reranked(spark, folder, QueryOptions(top_k=10, fetch_k=50, diversity=True, diversity_weight=0.3))


@query("query_request")
def query_request(spark, folder):
    """Filter, threshold, MMR and payload in one request."""
    options = QueryOptions(
        top_k=5, fetch_k=20, where=SEARCH_FILTER, threshold=0.1, mmr=True, mmr_lambda=0.7, payload=["lang", "source"]
    )
    hits = run_queries(given.points(spark, folder), given.vector_queries(spark, folder), options)
    return _hits(hits, F.round("mmr_score", 6).alias("mmr_score"), "lang", "source")


@query("query_flags")
def query_flags(spark, folder):
    """How many hits above a threshold each query got, and whether a re-ranker ran."""
    options = QueryOptions(top_k=5, threshold=0.35, mmr=True, mmr_lambda=0.7, where=flt.range_("label", gte=5))
    queries = given.vector_queries(spark, folder)
    return query_summary(run_queries(given.vectors(spark, folder), queries, options), queries, options)


# --- vectors and points -------------------------------------------------------


@query("pairwise_cosine")
def pairwise_cosine(spark, folder):
    """Every vector against the one before it."""
    own = given.vectors(spark, folder).select("id", "vector")
    before = own.select((F.col("id") + 1).alias("id"), F.col("vector").alias("other"))
    return own.join(before, "id").select("id", F.round(cosine(F.col("vector"), F.col("other")), 6).alias("cosine"))


@query("check_dims")
def check_vector_dims(spark, folder):
    short = F.when(F.col("label") == 3, F.slice("vector", 1, 32)).otherwise(F.col("vector"))
    wrong = check_dims(given.vectors(spark, folder).withColumn("vector", short), 64)
    return wrong.select("id", F.size("vector").alias("dim"))



@query("points_info")
def info(spark, folder):
    return points_info(given.vectors(spark, folder))



@query("upsert_points")
def upsert(spark, folder):
    """Re-label some points twice in one batch and add new ones."""
    old = given.vectors(spark, folder)
    first = old.where(F.col("label") <= 4).select("id", "vector", (F.col("label") + 100).alias("label"), F.lit(1).alias("turn"))
    second = old.where(F.col("label") <= 2).select("id", "vector", (F.col("label") + 200).alias("label"), F.lit(2).alias("turn"))
    added = old.where(F.col("label") == 7).select(
        (F.col("id") + 1_000_000).alias("id"), "vector", "label", F.lit(1).alias("turn")
    )
    result = upsert_points(old, first.unionByName(second).unionByName(added), order="turn", dim=64)
    return result.select("id", "label", F.size("vector").alias("dim"))



@query("delete_ids")
def delete_ids(spark, folder):
    toxic = given.table(spark, folder, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    return delete_points(given.vectors(spark, folder), ids=toxic).remaining.select("id", "label")


def _fixed(spark, folder, **options) -> DataFrame:
    chunks = chunk_documents(given.documents(spark, folder), keep_sentences=False, **options)
    return chunks.select("doc_id", "chunk_index", "start_index", "end_index", "tokens")


@query("delete_doc")
def delete_doc(spark, folder):
    return delete_points(_fixed(spark, folder), doc_id=7).remaining


@query("delete_filter")
def delete_filter(spark, folder):
    left = delete_points(given.points(spark, folder), where=flt.match("quality", 0)).remaining
    return left.select("id", "label", _shown("quality"))


@query("replace_by_doc")
def replace_by_doc(spark, folder):
    """Documents of good quality are chunked again, into smaller chunks."""
    good = given.table(spark, folder, "labels").where(F.col("quality") == 1).select("doc_id")
    again = _fixed(spark, folder, chunk_tokens=200).join(good, "doc_id", "left_semi")
    return replace_docs(_fixed(spark, folder), again, good)


# --- filters ------------------------------------------------------------------

FILTERS = {
    "filter_match": flt.match("lang", "en"),
    "filter_range": flt.range_("n_chars", gte=500, lt=3000),
    "filter_compound": {
        "must": [{"key": "lang", "match": {"value": "en"}}, {"key": "n_chars", "range": {"gte": 200}}],
        "should": [{"key": "quality", "match": {"value": 1}}, {"key": "source", "match": {"value": "src3"}}],
        "must_not": [{"key": "toxic", "match": {"value": 1}}],
    },
    "filter_in": flt.any_of("source", ["src1", "src7", "src14"]),
    "filter_not_in": flt.none_of("quality", [0]),
    "filter_metadata": flt.metadata({"lang": "fr", "quality": 1}),
    "filter_doc_id": flt.for_doc(7),
    "filter_exclude_docs": flt.not_docs([1, 2, 3]),
    "filter_combine_and": flt.combine_and_flat(
        flt.any_of("lang", ["en"]), flt.range_("n_chars", gte=1000), flt.none_of("toxic", [1])
    ),
    "filter_combine_or": flt.combine_or_flat(
        flt.match("lang", "fr"), flt.range_("n_chars", gte=5000), flt.none_of("quality", [0])
    ),
}


def _filter_query(spec: flt.Filter) -> Query:
    def run(spark, folder):
        kept = flt.filter_rows(given.labelled(spark, folder), spec)
        return kept.select("doc_id", "lang", "source", "n_chars", _shown("quality"), _shown("toxic"))

    return run


QUERIES.update({name: _filter_query(spec) for name, spec in FILTERS.items()})


# --- text ---------------------------------------------------------------------


@query("token_estimate")
def token_estimate(spark, folder):
    return given.documents(spark, folder).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("validate_text")
def validate_text(spark, folder):
    reason = tx.validation_reason(F.col("text"), 1000)
    return given.documents(spark, folder).select("doc_id", reason.isNull().alias("valid"), reason.alias("reason"))


@query("split_sentences")
def sentences(spark, folder):
    return split_sentences(given.documents(spark, folder))



@query("clean_text")
def clean_text(spark, folder):
    """Documents with mixed line ends, blank lines and tabs put in."""
    rough = F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n\r\n\r\n\r\n\t "))
    rough = F.concat(F.lit(" \t\n"), F.replace(rough, F.lit(", "), F.lit(",\r \t")), F.lit("\r\n\r"))
    return given.documents(spark, folder).select("doc_id", tx.clean_text(rough).alias("cleaned"))


@query("chunk_fixed")
def chunk_fixed(spark, folder):
    chunks = chunk_documents(given.documents(spark, folder), chunk_tokens=100, keep_sentences=False)
    return chunks.select("doc_id", "chunk_index", "start_index", "end_index", "text", "tokens")


@query("chunk_sentence")
def chunk_sentence(spark, folder):
    chunks = chunk_documents(given.documents(spark, folder))
    return chunks.select("doc_id", "chunk_index", "start_index", "end_index", "text", "tokens")


@query("chunk_ids")
def chunk_ids(spark, folder):
    chunks = chunk_documents(given.documents(spark, folder), keep_sentences=False)
    return chunks.select("doc_id", "chunk_index", "chunk_id")


@query("chunk_stats")
def chunk_statistics(spark, folder):
    chunks = chunk_documents(given.documents(spark, folder), keep=["lang"])
    return chunk_stats(chunks, "lang").select("lang", "chunks", F.round("avg_chunk_chars", 6).alias("avg_chunk_chars"))



@query("embed_chunks")
def embed_chunks(spark, folder):
    """The non-zero weights of every chunk's vector."""
    chunks = chunk_documents(given.documents(spark, folder))
    vectors = embed_texts(chunks, HASHING, share_copies=True)
    weights = vectors.select("doc_id", "chunk_index", F.posexplode("vector").alias("bucket", "weight"))
    return weights.where(F.col("weight") != 0).withColumn("weight", F.round("weight", 6))


@query("embed_summary")
def embed_totals(spark, folder):
    """Every document that has text, whatever its length."""
    usable = given.documents(spark, folder).where(tx.usable_text(F.col("text")))
    return embed_summary(chunk_documents(usable), 64)



# --- sources ------------------------------------------------------------------


@query("csv_to_text")
def csv_to_text(spark, folder):
    customers = number_rows(given.table(spark, folder, "customer"), ["c_custkey"])
    return csv_lines(customers, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


@query("extract_files")
def extract_file_text(spark, folder):
    """Raw web pages as uploaded files."""
    pages = given.table(spark, folder, "pages").select(
        F.concat_ws("-", "page_id", "url").alias("filename"), F.encode("html", "UTF-8").alias("content")
    )
    return extract_files(pages).select("filename", "size", "type", "content", "reason")



@query("sheet_rows")
def sheet_rows(spark, folder):
    rows = sheet_cells(given.sheet(spark, folder).withColumn("turn_no", F.col("turn")), ["turn_no"])
    return sheet_documents(
        rows,
        sheet="talks",
        key="conv_id",
        text_columns=["role", "text"],
        metadata_columns=["turn"],
        order=["turn_no"],
    )


@query("sheet_preview")
def sheet_first_rows(spark, folder):
    return sheet_preview(given.sheet(spark, folder), ["conv_id", "turn"])



@query("sheet_sync_stats")
def sheet_stats(spark, folder):
    rows = sheet_cells(given.sheet(spark, folder))
    docs = sheet_documents(rows, sheet="talks", key="conv_id", text_columns=["role", "text"])
    return sheet_sync_stats(with_chunk_count(docs))



@query("scan_missing_embedding")
def scan_missing_embedding(spark, folder):
    return scan_documents(given.sync_source(spark, folder), only_missing=True).select("doc_id", "lang", "n_chars")


@query("source_status")
def status(spark, folder):
    return source_status(given.sync_source(spark, folder))



# --- sync ---------------------------------------------------------------------


@query("sync_eligibility")
def sync_eligibility(spark, folder):
    action = sync_action(F.col("text"), F.col("embedding"), re_embed=False)
    return given.sync_source(spark, folder).select("doc_id", action.alias("action"))


@query("sync_preview")
def preview(spark, folder):
    return sync_preview(given.sync_source(spark, folder))



@query("sync_stats")
def stats(spark, folder):
    return sync_stats(given.sync_source(spark, folder), re_embed=False)



@query("sync_points")
def bulk_points(spark, folder):
    points = sync_points(
        given.sync_source(spark, folder), HASHING, synced_at=F.lit("2024-01-01T00:00:00.000Z"), metadata=["lang"]
    )
    return points.select(
        "id", "doc_id", "source", "lang", "chunk_index", "start_index", "end_index", "tokens", F.size("vector").alias("dim")
    )


@query("sheet_points")
def sheet_points(spark, folder):
    points = sync_sheet(
        sheet_cells(given.sheet(spark, folder).withColumn("turn_no", F.col("turn")), ["turn_no"]),
        HASHING,
        spreadsheet="book",
        sheet="talks",
        key="conv_id",
        text_columns=["role", "text"],
        metadata_columns=["turn"],
        order=["turn_no"],
        synced_at=F.lit("2024-01-01T00:00:00.000Z"),
    )
    return points.select(
        "id", "doc_id", "source", "sheet_name", "row_key", "turn", "chunk_index", "text", F.size("vector").alias("dim")
    )


REFUSING = lambda: given.Refusing(64, normalize=False)


def _sync_run(spark, folder) -> tuple[DataFrame, DataFrame, PointTable]:
    """Sync into a table that already has a point of every document."""
    points = PointTable(spark, scratch_path(spark, "points"), buckets=16)
    old = given.documents(spark, folder).select(
        F.concat(F.lit("old-"), "doc_id").alias("id"), "doc_id", F.array_repeat(F.lit(1.0), 64).alias("vector"), "lang", F.lit(-1).alias("chunk_index")
    )
    points.upsert(old)
    done, failed = run_sync(
        given.sync_source(spark, folder), points, REFUSING, synced_at=F.lit("2024-01-01T00:00:00.000Z"), metadata=["lang"]
    )
    return done, failed, points


@query("sync_run")
def sync_run(spark, folder):
    return _sync_run(spark, folder)[0]


@query("sync_errors")
def sync_errors(spark, folder):
    return _sync_run(spark, folder)[1]


@query("sync_written")
def sync_written(spark, folder):
    """The table after the sync: failed and skipped documents have their old point, the others their chunks."""
    points = _sync_run(spark, folder)[2].read()
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda t, x: t + F.abs(x)), 6)
    return points.select("id", "doc_id", "lang", "chunk_index", total.alias("weight"))


def _sync_twice(spark, folder) -> tuple[DataFrame, PointTable]:
    """A sync, and after some documents have changed, become blank, gone or come, one of what changed."""
    kind = F.pmod("doc_id", F.lit(10))
    docs = given.documents(spark, folder).select("doc_id", "text", "lang")
    text = F.when(kind == 0, F.concat("text", F.lit(" changed again"))).when(kind == 2, F.lit(" " * 80)).otherwise(F.col("text"))
    points = PointTable(spark, scratch_path(spark, "points"), buckets=16)
    how = {"metadata": ["lang"], "embedding": None, "cache": EmbeddingCache(spark, scratch_path(spark, "cache"))}
    run_sync(docs.where(kind != 3), points, COUNTING, synced_at=F.lit("first"), **how)
    later = docs.where(kind != 1).withColumn("text", text)
    return run_sync(later, points, COUNTING, synced_at=F.lit("second"), only_changed=True, drop_gone=True, **how)[0], points


@query("sync_incremental")
def sync_incremental(spark, folder):
    """The table after both: unchanged documents have the points of the first sync."""
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda t, x: t + F.abs(x)), 6)
    return _sync_twice(spark, folder)[1].read().select("id", "doc_id", "lang", "chunk_index", "synced_at", total.alias("weight"))


@query("sync_incremental_stats")
def sync_incremental_stats(spark, folder):
    return _sync_twice(spark, folder)[0]


def _cached(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Every other document's chunks through a cache, then all chunks, twice: the last vectors, and the texts sent each time."""
    cache, sent, before = EmbeddingCache(spark, scratch_path(spark, "cache")), [], 0
    chunks = chunk_documents(given.documents(spark, folder))
    for run, part in enumerate((chunks.where("doc_id % 2 = 1"), chunks, chunks), 1):
        vectors = cache.embed(part, HASHING)
        after = cache.known(HASHING()).count()
        sent.append((run, after - before))
        before = after
    return vectors, spark.createDataFrame(sent, "run int, texts bigint")


@query("embed_cached")
def embed_cached(spark, folder):
    weights = _cached(spark, folder)[0].select("doc_id", "chunk_index", F.posexplode("vector").alias("bucket", "weight"))
    return weights.where(F.col("weight") != 0).withColumn("weight", F.round("weight", 6))


@query("embed_cache_runs")
def embed_cache_runs(spark, folder):
    return _cached(spark, folder)[1]


@query("sheet_sync_errors")
def sheet_errors(spark, folder):
    """Every last row of a talk, of which some cannot be embedded."""
    rows = sheet_cells(given.sheet(spark, folder).withColumn("turn_no", F.col("turn")), ["turn_no"])
    how = {"sheet": "talks", "key": "conv_id", "text_columns": ["role", "text"], "order": ["turn_no"]}
    points = sync_sheet(rows, REFUSING, spreadsheet="book", synced_at=F.lit("now"), error="error", **how)
    docs = with_chunk_count(sheet_documents(rows, **how))
    return sheet_sync_stats(docs, failed=settle(points)[1])


@query("points_table")
def points_table(spark, folder):
    """Upsert, delete by id, by document and by filter, and replace, through the table on disk."""
    points = PointTable(spark, scratch_path(spark, "points"), buckets=16)
    all_ = given.vectors(spark, folder).withColumn("doc_id", F.pmod("id", F.lit(50)))
    points.upsert(all_)
    doubled = F.transform("vector", lambda x: x * F.lit(2).cast("float"))
    points.upsert(all_.where("label <= 2").withColumn("vector", doubled))
    points.delete(ids=all_.where("id % 11 = 0").select("id"))
    points.delete(doc_id=7)
    points.delete(where=flt.match("label", 5))
    points.replace(all_.where("doc_id = 9 and id < 200").withColumn("label", F.lit(99)), all_.where("doc_id = 9").select("doc_id"))
    total = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return points.read().select("id", "doc_id", "label", F.round(total, 5).alias("total"))


@query("search_filtered_variant")
def search_filtered_variant(spark, folder):
    """The filter's keys are in a free payload."""
    options = QueryOptions(where=SEARCH_FILTER)
    return _hits(run_queries(given.free_points(spark, folder), given.vector_queries(spark, folder), options))


@query("delete_filter_variant")
def delete_filter_variant(spark, folder):
    left = delete_points(given.free_points(spark, folder), where=flt.match("quality", 0)).remaining
    return left.select("id", "label", F.coalesce(F.expr("try_variant_get(payload, '$.quality', 'int')"), F.lit(-1)).alias("quality"))


@query("search_filtered_shredded")
def search_filtered_shredded(spark, folder):
    """The same on a stored table that keeps the filter's keys as columns beside the payload, by document."""
    keys = {"lang": "string", "n_chars": "double", "toxic": "double"}
    kept = stored(flt.shred(given.free_points(spark, folder), keys).sortWithinPartitions("payload_keys.lang"), "points")
    return _hits(run_queries(kept, given.vector_queries(spark, folder), QueryOptions(where=SEARCH_FILTER)))


@query("query_with_vectors")
def query_with_vectors(spark, folder):
    """Re-ranked hits with their vectors, of which the elements are summed."""
    options = QueryOptions(top_k=5, fetch_k=20, mmr=True, mmr_lambda=0.7, where=SEARCH_FILTER, threshold=0.1, with_vectors=True, payload=["lang", "source"])
    hits = run_queries(given.points(spark, folder), given.vector_queries(spark, folder), options)
    total = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return _hits(hits, F.round("mmr_score", 6).alias("mmr_score"), "lang", "source", F.round(total, 5).alias("total"))


@query("compose_payload")
def payload(spark, folder):
    """A document's own source wins over the base one; German documents have none."""
    docs = given.labelled(spark, folder).withColumn("source", F.when(F.col("lang") != "de", F.col("source")))
    composed = compose_payload(
        docs, source="mongo", synced_at=F.lit("2024-01-01T00:00:00.000Z"), metadata=["source", "lang", "quality"]
    )
    return composed.select("doc_id", "source", "synced_at", "lang", _shown("quality"))



# --- changes ------------------------------------------------------------------


@query("cdc_classify")
def cdc_classify(spark, folder):
    changes = classify_changes(given.change_events(given.table(spark, folder, "events")))
    return changes.select(F.col("seq.event_id").alias("event_id"), "doc_id", "op", "action")


CHANGES = ChangeSettings(HASHING, metadata=["category"])


def _changed(points: DataFrame) -> DataFrame:
    return points.select("doc_id", "chunk_index", "start_index", "end_index", "tokens", "text", "category")


@query("cdc_apply")
def cdc_apply(spark, folder):
    """Change events applied to the chunks of the documents they are about."""
    chunks = chunk_documents(given.documents(spark, folder), keep_sentences=False, keep=["lang"])
    points = chunks.withColumnRenamed("lang", "category")
    changes = given.change_events(given.table(spark, folder, "events"))
    return _changed(apply_changes(points, changes, CHANGES))


@query("cdc_stream")
def cdc_stream(spark, folder):
    """The same events through a streaming query, into a change log."""
    events = given.table(spark, folder, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events*.parquet")  # a glob takes a file or a folder
    log = ChangeLog(spark, scratch_path(spark, "change-log"))
    log.follow(given.change_events(stream), scratch_path(spark, "stream"), CHANGES, once=True).awaitTermination()
    return _changed(log.points())


@query("cdc_compacted")
def cdc_compacted(spark, folder):
    """The same events in three batches, late ones among them, the log folded in between."""
    events = given.table(spark, folder, "events")
    log = ChangeLog(spark, scratch_path(spark, "change-log"))
    for batch in range(3):
        part = events.where(F.pmod("event_id", F.lit(3)) == 2 - batch)
        log.write_batch(given.change_events(part), batch, CHANGES)
        log.compact()
    return _changed(log.points())


@query("cdc_recovered")
def cdc_recovered(spark, folder):
    """The stream stops, more events arrive, and it goes on from its checkpoint."""
    events = given.table(spark, folder, "events")
    inbox, checkpoint = scratch_path(spark, "inbox"), scratch_path(spark, "stream")
    log = ChangeLog(spark, scratch_path(spark, "change-log"))
    for half in range(2):
        events.where(F.pmod("event_id", F.lit(2)) == half).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(events.schema).parquet(inbox)
        log.follow(given.change_events(stream), checkpoint, CHANGES, once=True).awaitTermination()
    return _changed(log.points())


@query("sheet_stream")
def sheet_stream(spark, folder):
    """A sheet exported as CSV, taken in by the scheduled query."""
    inbox = scratch_path(spark, "exports")
    rows = given.sheet(spark, folder).select("conv_id", "turn", "role", "text")
    rows = rows.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "turn")  # all turns of a talk in one file
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**plain).csv(inbox)
    log = ChangeLog(spark, scratch_path(spark, "change-log"))
    settings = ChangeSettings(HASHING, metadata=["turn"])
    follow_sheet(
        log, inbox, rows.columns, scratch_path(spark, "stream"), settings,
        spreadsheet="book", sheet="talks", key="conv_id", text_columns=["role", "text"], metadata_columns=["turn"],
    ).awaitTermination()
    return log.points().select("doc_id", "chunk_index", "text", "turn")


# --- requests whose parts are not seen above -----------------------------------


@query("sync_points_fixed")
def fixed_points(spark, folder):
    """A sync that cuts without regard to sentences."""
    options = ChunkOptions(keep_sentences=False)
    points = sync_points(given.sync_source(spark, folder), HASHING, options, synced_at=F.lit("now"))
    return points.select("doc_id", "chunk_index", "start_index", "end_index", "tokens")


@query("delete_dispatch")
def delete_dispatch(spark, folder):
    """Ids win over a document, a document over a filter; an empty list of ids counts as none."""
    points = given.vectors(spark, folder).withColumn("doc_id", F.pmod("id", F.lit(50)))
    requests = {
        "all": {"ids": [1, 2, 3], "doc_id": 7, "where": flt.match("label", 5)},
        "document": {"ids": [], "doc_id": 7, "where": flt.match("label", 5)},
        "filter": {"where": flt.match("label", 5)},
    }
    out = None
    for name, request in requests.items():
        found = delete_points(points, **request)
        row = found.deleted.agg(F.count(F.lit(1)).alias("deleted")).select(
            F.lit(name).alias("request"), F.lit(found.deleted_by).alias("deleted_by"), "deleted"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("ensure_dataset")
def ensure_dataset(spark, folder):
    """A table made by its first points; asking again changes nothing."""
    points = PointTable(spark, scratch_path(spark, "points"), buckets=16)
    _, made = points.upsert(given.vectors(spark, folder), metric="euclid")
    again = points.ensure(64, "euclid")
    return points.info().withColumns({"made": F.lit(made), "again": F.lit(again)})


@query("csv_from_files")
def csv_from_files(spark, folder):
    """Customers exported as CSV and read again; rows are numbered within a file, so it is one file."""
    path = scratch_path(spark, "csv")
    columns = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    given.table(spark, folder, "customer").select(*columns).orderBy("c_custkey").coalesce(1).write.option("header", True).csv(path)
    return csv_lines(read_csv_rows(spark, path), columns).select("row_number", "line")


@query("extract_kinds")
def extract_kinds(spark, folder):
    """Pages as files of several kinds: ragged CSV, text, blank, one without a parser."""
    kind = F.pmod("page_id", F.lit(4))
    table = F.concat(F.lit("id,url\n"), F.col("page_id").cast("string"), F.lit(',"'), "url", F.lit('",more\n'))
    content = F.when(kind == 0, table).when(kind == 2, F.lit(" \n\t ")).otherwise(F.col("html"))
    ends = F.element_at(F.array(*map(F.lit, (".csv", ".txt", ".md", ".pdf"))), (kind + 1).cast("int"))
    files = given.table(spark, folder, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string"), ends).alias("filename"), F.encode(content, "UTF-8").alias("content")
    )
    return extract_files(files).select("filename", "type", "content", F.coalesce("row_count", F.lit(-1)).alias("row_count"), "reason")
