"""Work on many small groups without one Python call per group.

Rows are brought together by key, sorted within their partition, and read as Arrow batches; the groups are cut
out of each batch with numpy. A group that crosses a batch border is put together before it is handed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def group_starts(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which a new group of ``keys`` begins in sorted rows."""
    changed = np.zeros(len(pdf), dtype=bool)
    changed[:1] = True
    for key in keys:
        column = pdf[key].to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(changed)


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Re-cut batches so that no group is split; only the last group of a batch is held back."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if len(pdf) == 0:
            continue
        if rest:
            pdf = pd.concat([*rest, pdf], ignore_index=True)
            rest = []
        cut = group_starts(pdf, keys)[-1]
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
        rest = [pdf.iloc[cut:].reset_index(drop=True)]
    if rest:
        yield rest[0]


def map_sorted(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    step: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """Run ``step`` over the sorted batches of each partition; rows with equal ``by`` share a partition."""
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(step, schema)
