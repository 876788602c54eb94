"""Views of the given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.embedding import HashingProvider


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels; most have none, so the label columns are often missing."""
    return documents(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with the payload of the document of the same id; many have none."""
    docs = labelled(spark, folder).select(F.col("doc_id").alias("id"), "lang", "source", "n_chars", "quality", "toxic")
    return vectors(spark, folder).join(docs, "id", "left")


def free_points(spark: SparkSession, folder: str) -> DataFrame:
    """The same points with their payload in one VARIANT column; no key of it is known to the schema."""
    payload = F.to_json(F.struct("lang", "source", "n_chars", "quality", "toxic"))
    return points(spark, folder).select("id", "vector", "label", F.parse_json(payload).alias("payload"))


class Refusing(HashingProvider):
    """A provider that fails on texts with a certain word."""

    word = "stupid"

    def embed_batch(self, texts):
        if any(self.word in text for text in texts):
            raise ValueError("text refused")
        return super().embed_batch(texts)


def vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored vector as a query."""
    return vectors(spark, folder).select(F.col("id").alias("query_id"), "vector")


def text_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def sync_source(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a sync finds them: some without text, some with a vector already."""
    text = F.when(F.col("toxic") == 1, F.lit(None)).when(F.col("quality") == 0, F.lit("")).otherwise(F.col("text"))
    known = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return labelled(spark, folder).withColumn("text", text).join(known, "doc_id", "left")


def sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as a sheet of string cells; the key repeats, the last row of it counts."""
    return table(spark, folder, "conversations")


def change_events(events: DataFrame) -> DataFrame:
    """Events as changes of the document numbered like the user."""
    kind = F.col("event_type")
    op = (
        F.when(kind == "signup", "insert")
        .when(kind.isin("click", "purchase"), "update")
        .when(kind == "error", "delete")
        .otherwise(kind)
    )
    cents = F.round(F.col("value") * 100).cast("bigint")
    body = F.concat_ws(" ", F.lit("event"), kind, F.lit("of user"), F.col("user_id"), F.lit("worth"), cents, F.col("props"))
    text = F.when((kind == "purchase") & (F.col("value") < 5), F.lit(None)).otherwise(body)
    document = F.struct(text.alias("text"), kind.alias("category"))
    return events.select(
        F.struct("ts", "event_id").alias("seq"),
        op.alias("op"),
        F.col("user_id").alias("doc_id"),
        F.when((kind == "error") | ((kind == "click") & (F.col("value") < 3)), F.lit(None))
        .otherwise(document)
        .alias("full_document"),
    )
