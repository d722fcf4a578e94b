"""Search for texts that names contain, by posting lists of the short pieces of each name.

A piece has one to three characters. The list of a text's rarest pieces gives few candidates, which are compared exactly; texts of up to
three characters are a piece themselves. So a search reads the rows of a few pieces and never all names, and gives the rows of a scan.
The index has a segment per task that reads names, with a row for each piece and batch of names, so postings are never shuffled.

Case does not count; ``%`` and ``_`` stand for themselves. An empty text is in every name, a null text or name in none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..plans.hotkeys import first_per_key

PIECE = 3
RAREST = 2  # lists that candidates of a longer text must be on


def pieces(column: Column, sizes: range = range(PIECE + 1)) -> Column:
    """The different pieces of a text in lower case of the given numbers of characters; the empty one is in every text."""
    low = F.lower(column)

    def of_size(n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - (n - 1)))
        return F.filter(F.transform(starts, lambda at: F.substr(low, at, F.lit(n))), lambda piece: F.length(piece) == n)

    return F.array_distinct(F.concat(*[of_size(n) for n in sizes]))


def postings(names: DataFrame, id_col: str, name_col: str = "name") -> DataFrame:
    """(piece, ids): a row for each piece that names of a batch have, with the ids of these names, each as often as it has such a row."""
    rows = names.filter(F.col(name_col).isNotNull()).select(F.lower(name_col).alias("name"), F.col(id_col).alias("id"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            with_piece: dict[str, list[int]] = {"": list(range(batch.num_rows))}
            for row, name in enumerate(batch.column("name").to_pylist()):
                for piece in {name[at : at + n] for n in range(1, PIECE + 1) for at in range(len(name) - n + 1)}:
                    with_piece.setdefault(piece, []).append(row)
            ends = [0]
            for found in with_piece.values():
                ends.append(ends[-1] + len(found))
            ids = batch.column("id").take(pa.array(chain.from_iterable(with_piece.values()), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(with_piece.keys(), pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], ["piece", "ids"]
            )

    return rows.mapInArrow(step, f"piece string, ids array<{rows.schema['id'].dataType.simpleString()}>")


def write_index(names: DataFrame, folder: str, id_col: str, name_col: str = "name") -> None:
    """Posting lists in order of their pieces in each segment, so that a search reads the row groups of its pieces only, and their lengths.

    A piece that many names have fills a row for each batch of names, never one row.
    """
    postings(names, id_col, name_col).sortWithinPartitions("piece").write.parquet(f"{folder}/lists")
    written = names.sparkSession.read.parquet(f"{folder}/lists")
    written.groupBy("piece").agg(F.sum(F.size("ids")).alias("n")).write.parquet(f"{folder}/lengths")


def chosen_pieces(texts: DataFrame, lengths: DataFrame, text_col: str) -> DataFrame:
    """(text, piece, n): the rarest pieces of each different text, n of how many it needs. No row if a piece is in no name."""
    own = texts.select(F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    short = F.length(F.lower("text"))
    parts = F.when(short <= PIECE, F.array(F.lower("text"))).otherwise(pieces(F.col("text"), range(PIECE, PIECE + 1)))
    wide = own.select("text", F.explode(parts).alias("piece"), F.size(parts).alias("all"))
    known = wide.join(lengths.withColumnRenamed("n", "rows"), "piece")
    whole = known.groupBy("text").agg(F.count("*").alias("found"), F.first("all").alias("all")).filter(F.col("found") == F.col("all"))
    rare = first_per_key(known.select("text", "piece", "rows"), ["text"], RAREST, ["rows", "piece"])
    return rare.join(whole, "text").select("text", "piece", F.least(F.col("all"), F.lit(RAREST)).alias("n"))


def matches(
    spark: SparkSession, folder: str, names: DataFrame, texts: DataFrame, id_col: str, name_col: str = "name", text_col: str = "text"
) -> DataFrame:
    """One row per different text of ``texts`` and row of ``names`` whose name contains it: ``text`` and the columns of ``names``."""
    chosen = chosen_pieces(texts, spark.read.parquet(f"{folder}/lengths"), text_col)
    lists = spark.read.parquet(f"{folder}/lists")
    met = lists.join(chosen, "piece").select("text", "n", F.explode("ids").alias("id"))
    on_all = met.groupBy("text", "id").agg(F.count("*").alias("on"), F.first("n").alias("n"))
    candidates = on_all.filter(F.col("on") == F.col("n")).select(F.col("text").alias("_text"), F.col("id").alias("_id"))
    found = names.join(candidates, names[id_col] == F.col("_id"))
    return found.filter(text.contains_ci(F.col(name_col), F.col("_text"))).select(F.col("_text").alias("text"), *names.columns)


def candidates(spark: SparkSession, folder: str, wanted: str) -> DataFrame:
    """Ids that may contain one text, for a caller's own filters and order. The pieces reach the scan as a pushed filter."""
    low = wanted.lower()
    own = [low] if len(low) <= PIECE else sorted({low[i : i + PIECE] for i in range(len(low) - PIECE + 1)})
    lists = spark.read.parquet(f"{folder}/lists").filter(F.col("piece").isin(own))
    return lists.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("on")).filter(F.col("on") == len(own)).select("id")
