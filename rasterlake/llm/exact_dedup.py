"""Exact de-duplication by a heavy-hitter split, with DataFrame functions only.

A mergeable Misra-Gries summary (Spark's ``approx_top_k``) finds digests that may be frequent. Their rows are counted exactly, and the
verified winners, at most ``hot`` rows whatever the input, are broadcast: rows of frequent digests are settled where they are read and
never shuffled. All other digests hold at most a small share of the rows each, so an ordinary shuffle on the digest is even.

Defined cases: a null text counts as empty; a null id never wins against an id; of equal ids with equal texts (repeated rows) all carry
the same result in ``mark_copies`` and one row is left by ``drop_copies``; other columns pass through ``drop_copies`` under any name.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_or_empty, without

HOT = 1000
TRACKED = 65_536


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document: ``doc_id``, ``text_sha256``."""
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"))


def frequent_winners(rows: DataFrame, hot: int = HOT, tracked: int = TRACKED) -> DataFrame:
    """``text_sha256``, ``keep_id``, ``group_size`` of digests that the summary proposes and an exact count confirms."""
    proposed = rows.agg(F.expr(f"approx_top_k(text_sha256, {hot}, {tracked})").alias("top")).select(
        F.explode("top.item").alias("text_sha256")
    )
    return (
        rows.join(F.broadcast(proposed), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )


def mark_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, tracked: int = TRACKED
) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    rows = cut_lineage(digests(docs, id_col, text_col))
    winners = F.broadcast(cut_lineage(frequent_winners(rows, hot, tracked)))
    settled = rows.join(winners, "text_sha256")
    rest = rows.join(winners, "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return settled.unionByName(rest.join(groups, "text_sha256")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text no row with a larger id has, with all their columns."""
    marked = cut_lineage(mark_copies(docs, id_col, text_col))
    return without(docs, {"doc_id": F.col(id_col), "text_sha256": F.sha2(text_or_empty(text_col), 256)}, marked)
