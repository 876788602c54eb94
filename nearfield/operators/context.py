"""Assemble the answer context of each query from its hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assemble_context(hits: DataFrame, *, text: str = "text", title: str = "title") -> DataFrame:
    """One row per query: hit texts in rank order joined by a blank line, and ``sources (id, title, score)``.

    A query has at most as many hits as it asked for, so a row stays small.
    """
    ordered = F.sort_array(F.collect_list(F.struct("rank", "id", "score", F.col(title), F.col(text))))
    grouped = hits.groupBy("query_id").agg(ordered.alias("h"))
    return grouped.select(
        "query_id",
        F.array_join(F.transform("h", lambda h: h[text]), "\n\n").alias("context"),
        F.transform(
            "h", lambda h: F.struct(h["id"].alias("id"), h[title].alias("title"), h["score"].alias("score"))
        ).alias("sources"),
    )
