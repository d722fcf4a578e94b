"""Language identification by nearest centroid.

A text is a vector of hashed character n-grams (1 to 3 bytes of its lower-cased letters), weighted by TF-IDF and normalised. Each
language has several centroids, found by clustering; a text gets the language of the centroid with the largest cosine, and is rejected
when that cosine is far below what the centroid's own training texts have.

Document frequencies cover all labelled texts. The clustering is fitted on a bounded sample: of every language the ``per_lang`` different
labelled texts (SAMPLE by default, whole texts) with the smallest hashes of id and text. Its size depends on the number of languages alone.

Defined cases: a null text or one without any letter is ``und`` with score 0 and rejected, as is every text when there are no labelled
rows; rows with a null label or text are not learned from, rows with null or equal ids are; a row that is
repeated is one of the sample; of equal cosines the first language by code point wins; repeated rows get
equal results; an empty table gives an empty result; other columns pass through ``identify`` under any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.hotkeys import first_per_key
from ..session import cut_lineage
from .common import free_name, sized, slices, small_batches

BITS = 13
SIZE = 1 << BITS
SAMPLE = 300
MARGIN = 4
CENTROIDS = 4
ROUNDS = 12
REJECT = 0.5  # of the cosine that nearly all training texts of a centroid reach
FULL = 400  # different n-grams of a text that is judged by its cosine alone
BLOCK = 1 << 20
SLICE = 128
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
# Letters and bytes above ASCII are kept, all else is a gap.
_BYTES = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint8)
# Odd multipliers, one for each length of n-gram.
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole text."""
    data = _BYTES[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    total = np.zeros(SIZE, np.int64)
    for at in range(0, len(data), BLOCK):
        part = data[max(0, at - 2):at + BLOCK].astype(np.uint32)
        gap = part == 32
        part = part[~gap | np.concatenate(([True], ~gap[:-1]))]  # runs of gaps become one
        code = np.zeros_like(part)
        for n, multiplier in enumerate(_MULTIPLIERS):
            code = (code[:len(part) - n] << 8 | part[n:]) if n else part
            if not len(code):
                break
            total += np.bincount(code * multiplier >> np.uint32(32 - BITS), minlength=SIZE)
    return total


class Model(NamedTuple):
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    reach: np.ndarray  # cosine below which a text of many n-grams is rejected


def _fullness(tf: np.ndarray) -> np.ndarray:
    """Up to 1. A text of few different n-grams can't come near any centroid, so it is rejected at a smaller cosine only."""
    return np.sqrt(np.minimum(1.0, (tf > 0).sum(axis=1) / FULL))


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(tf).astype(np.float32) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _cluster(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids by spherical k-means from a farthest-first start, and the cosine that nearly all their rows reach."""
    centre = rows.mean(axis=0)
    chosen = [int(np.argmax(rows @ centre))]
    near = rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)) and near.min() < 1 - 1e-6:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centroids = rows[chosen]
    for _ in range(ROUNDS):
        own = np.argmax(rows @ centroids.T, axis=1)
        centroids = np.stack([rows[own == c].mean(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    cosines = rows @ centroids.T
    own, best = np.argmax(cosines, axis=1), cosines.max(axis=1)
    reach = np.array([np.quantile(best[own == c], 0.02) if (own == c).any() else 1.0 for c in range(len(centroids))])
    return centroids, reach


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_lang: int = SAMPLE, centroids: int = CENTROIDS,
) -> Model:
    """A model from labelled rows; the driver receives the document frequencies and the centroids only."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(
        F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).filter("text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, seen = 0, np.zeros(SIZE, np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                if has_letter(text):
                    docs += 1
                    seen += counts(text) > 0
        if docs:
            at = np.append(np.flatnonzero(seen), SIZE)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.append(seen, docs)[at])], ["at", "n"])

    df = rows.select("text").mapInArrow(frequencies, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    every = np.zeros(SIZE + 1, np.int64)
    every[df["at"].to_numpy(dtype=np.int64)] = df["n"].to_numpy(dtype=np.int64)
    idf = (np.log((1 + every[SIZE]) / (1 + every[:SIZE])) + 1).astype(np.float32)

    # Of a large language only a narrow range of hashes is looked at; its share holds several times the sample, so what is taken is
    # the same, and the rows sorted do not grow with the table. A language of few different rows, which may have too few hashes in its
    # range, is taken again without it.
    labels = rows.filter(F.col("text").rlike(r"\p{L}")).select("lang", "h")
    share = sized(labels.groupBy("lang").agg((F.lit(MARGIN * per_lang) / F.count("*") + F.lit(1e-9)).alias("share")))
    low = labels.join(share, "lang").filter(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    taken = cut_lineage(first_per_key(low.select("lang", "h").distinct(), ["lang"], per_lang, ["h"]).select("lang", "h"))
    had = taken.groupBy("lang").agg(F.count("*").alias("n"))
    short = sized(share.join(had, "lang", "left").filter((F.col("share") < 1) & (F.coalesce("n", F.lit(0)) < per_lang)).select("lang"))
    if not short.isEmpty():
        again = labels.join(short, "lang", "left_semi").distinct()
        taken = taken.union(first_per_key(again, ["lang"], per_lang, ["h"]).select("lang", "h")).distinct()
    sample = rows.join(sized(taken), ["lang", "h"], "left_semi").select("lang", "h", "text")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, int]] = set()  # of the sample, so bounded like it
        for batch in batches:
            new = []
            for lang, h, text in zip(batch["lang"], batch["h"], batch["text"]):
                if (lang, h) not in seen and has_letter(text):
                    seen.add((lang, h))
                    new.append((lang, h, counts(text).astype(np.float32)))
            if new:
                yield pd.DataFrame(new, columns=["lang", "h", "tf"])

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tf = np.stack(group["tf"].to_list())
        found, reach = _cluster(weighted(tf[np.lexsort(tf.T[:8])], idf), centroids)
        return pd.DataFrame({"lang": key[0], "c": range(len(found)), "centroid": list(found), "reach": reach})

    fitted = (
        sample.mapInPandas(features, "lang string, h bigint, tf array<float>")
        .groupBy("lang", "h").agg(F.first("tf").alias("tf")).select("lang", "tf")
        .groupBy("lang").applyInPandas(fit, "lang string, c int, centroid array<float>, reach double")
        .toPandas().sort_values(["lang", "c"])
    )
    if fitted.empty:
        return Model([], idf, np.zeros((0, SIZE), np.float32), np.zeros(0))
    return Model(
        fitted["lang"].to_list(), idf, np.stack(fitted["centroid"].to_list()).astype(np.float32), fitted["reach"].to_numpy() * REJECT
    )


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with ``lang_pred``, ``score`` (the cosine) and ``rejected``, under free names."""
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    text = free_name(docs.columns, "the_text")
    added = [free_name(docs.columns, n) for n in ("lang_pred", "score", "rejected")]
    rows = docs.select(*keep, F.col(text_col).alias(text))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, SLICE):
            langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            rejected = np.ones(batch.num_rows, dtype=bool)
            texts = batch.column(text).to_pylist()
            usable = [i for i, x in enumerate(texts) if x and has_letter(x)] if m.langs else []
            if usable:
                tf = np.stack([counts(texts[i]) for i in usable])
                cosines = weighted(tf, m.idf) @ m.centroids.T
                best = np.argmax(cosines, axis=1)
                top = cosines[np.arange(len(usable)), best]
                scores[usable] = np.clip(top, 0.0, 1.0)
                rejected[usable] = top < m.reach[best] * _fullness(tf)
                for i, c in zip(usable, best):
                    langs[i] = m.langs[c]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(langs), pa.array(scores), pa.array(rejected)], [*keep, *added]
            )

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema][:-1]
    return rows.mapInArrow(step, ", ".join([*schema, f"`{added[0]}` string", f"`{added[1]}` double", f"`{added[2]}` boolean"]))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with the same columns."""
    rejected = free_name(docs.columns, "rejected")
    return identify(docs, model, text_col).filter(~F.col(rejected)).select(*docs.columns)
