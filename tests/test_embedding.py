import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from nearfield.operators.embedding import (
    HashingProvider, attach_vectors, embed_summary, embed_texts, provider_factory, register_provider,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counting:
    """Records in each vector how many texts came with the call."""

    name, dimensions, max_input_tokens = "counting", 2, 100

    def embed_batch(self, texts):
        assert 0 < len(texts) <= 100 and len(set(texts)) == len(texts)
        return np.array([[len(t), len(texts)] for t in texts], dtype=float)


def test_slices_order_and_copies(spark):
    texts = [("x" * (i % 250 + 1)) for i in range(1000)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    register_provider("counting", Counting)
    for share in (False, True):
        rows = embed_texts(df, provider_factory("counting"), share_copies=share).collect()
        assert len(rows) == 1001
        for r in rows:
            assert (r.vector is None) if r.text is None else (r.vector[0] == len(r.text))
    assert embed_texts(df.limit(0), provider_factory("counting")).count() == 0


def test_hot_text_is_split(spark):
    hot = "hot " * 500
    body = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.lit("t "), F.repeat(F.col("id").cast("string"), 300)))
    pad = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{i}")), 256) for i in range(8)])  # as copies compress
    df = spark.range(3000).select("id", body.alias("text"), pad.alias("pad")).repartition(16, "id")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        out = embed_texts(df, provider_factory("hashing", dimensions=4), share_copies=True)
        parts = out.select(F.spark_partition_id().alias("p"), (F.col("text") == hot).alias("hot"), "id", "pad").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len({r.p for r in parts if r.hot}) > 1 and len({r.id for r in parts}) == 3000


def test_hashing_provider():
    p = HashingProvider(32)
    one, two, none = p.embed_batch(["Word word\tother", "word WORD other", "  "])
    assert np.allclose(one, two) and np.isclose((one * one).sum(), 1) and not none.any()
    assert p.embed_batch(["a"]).shape == (1, 32) and p.embed_batch([]).shape == (0, 32)


def test_unknown_provider():
    with pytest.raises(ValueError, match="unknown embedding provider"):
        provider_factory("nothing")


def test_precomputed_vectors(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string")
    known = spark.createDataFrame([(1, [0.5])], "doc_id int, vector array<double>")
    assert {r.doc_id: r.vector for r in attach_vectors(chunks, known, "doc_id").collect()} == {1: [0.5], 2: []}


def test_summary(spark):
    chunks = spark.createDataFrame([(1, 10), (1, 5), (2, 1)], "doc_id int, tokens int")
    rows = {r.doc_id: (r.total_chunks, r.total_tokens, r.embedding_dimensions) for r in embed_summary(chunks, 8, "doc_id").collect()}
    assert rows == {1: (2, 15, 8), 2: (1, 1, 8)}
    assert embed_summary(chunks.limit(0), 8).first().asDict() == {"total_chunks": 0, "total_tokens": 0, "embedding_dimensions": 8}


class Picky(Counting):
    """Fails on some texts."""

    def embed_batch(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("cannot embed this")
        return super().embed_batch(texts)


def test_failures_are_kept_apart(spark):
    from nearfield.plans.ingest import settle, sync_points

    docs = spark.createDataFrame(
        [(i, ("bad" if i % 10 == 0 else "good") + f" text {i}") for i in range(200)] + [(500, "fine. " * 400 + "bad")],
        "doc_id int, text string",
    )
    points = sync_points(docs, Picky, synced_at=F.lit("t"), embedding=None, error="error")
    good, failed = settle(points)
    assert {r.doc_id: r.error for r in failed.collect()} == {i: "cannot embed this" for i in [*range(0, 200, 10), 500]}
    rows = good.collect()
    assert {r.doc_id for r in rows} == {i for i in range(200) if i % 10} and all(r.vector is not None for r in rows)
    with pytest.raises(Exception, match="cannot embed this"):
        sync_points(docs, Picky, synced_at=F.lit("t"), embedding=None).collect()


def test_words_of_few_texts_are_held_at_a_time():
    """What a task holds doesn't grow with its rows; results don't depend on the cut."""
    from nearfield.operators.embedding import BLOCK, HashingProvider

    provider, seen = HashingProvider(8), []
    whole = provider._embed_block
    provider._embed_block = lambda texts: seen.append(len(texts)) or whole(texts)
    texts = [f"word{i} word{i % 7} other" for i in range(3 * BLOCK + 5)]
    got = provider.embed_batch(texts)
    assert max(seen) <= BLOCK and sum(seen) == len(texts)
    assert (got == whole(texts)).all() and provider.embed_batch([]).shape == (0, 8)


def test_vectors_come_in_blocks(spark):
    from nearfield.operators.embedding import BLOCK, HashingProvider

    texts = [(i, None if i % 50 == 3 else f"text {i % 900}") for i in range(5 * BLOCK + 1)]
    rows = embed_texts(spark.createDataFrame(texts, "n int, text string").coalesce(1), lambda: HashingProvider(8)).collect()
    provider = HashingProvider(8)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.vector is None if r.text is None else r.vector == provider.embed_batch([r.text])[0].tolist()
