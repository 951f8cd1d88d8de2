"""Order-dependent steps over many short stretches: one Python call for a batch of rows, not one per stretch.

A stretch is a run of rows with the same keys that no result crosses. Rows are dealt by series (the first
``series`` of the keys), which the windows that cut the stretches have done already, sorted within
their partition, and streamed; only the stretch at a batch's end waits for the next batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame

Columns = dict[str, np.ndarray]


def dealt(rows: DataFrame, series: list[str]) -> DataFrame:
    """Rows with all of a series in one partition; windows over the series need no other shuffle."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *series)


def over_stretches(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[Columns], list[tuple]], schema: str) -> DataFrame:
    """``work``'s rows of every stretch behind its keys. ``rows`` have all of a key in one partition (dealt());
    ``work`` gets a stretch's columns as arrays, in order, and returns rows of ``schema`` less the keys. Null keys are one key."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(part: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        columns = {c: part[c].to_numpy() for c in part.columns}
        heads = [columns[k] for k in keys]
        out = [(*[h[lo] for h in heads], *row) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True) for row in work({c: v[lo:hi] for c, v in columns.items()})]
        return pd.DataFrame(out, columns=[*keys, *names])

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            new = np.zeros(len(batch), bool)
            new[0] = True
            for k in keys:
                column, none = batch[k].to_numpy(), batch[k].isna().to_numpy()
                new[1:] |= (column[1:] != column[:-1]) & ~(none[1:] & none[:-1])
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield run(batch, starts)
            rest = batch.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None:
            yield run(rest, np.array([0, len(rest)]))

    kinds = dict(rows.dtypes)
    typed = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return rows.sortWithinPartitions(*keys, *order).mapInPandas(stream, f"{typed}, {schema}")


def _starts(part: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which another key begins. Null keys are one key."""
    new = np.zeros(part.num_rows, bool)
    new[:1] = True
    for k in keys:
        codes = part[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def over_series(rows: DataFrame, keys: list[str], order: list[Column], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work``'s batches (of ``schema``) over whole series, as many in a call as a batch of rows holds: it gets their rows in
    order and the row at which each series begins. For steps whose columns are worked on as arrays, without a frame per series."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the series that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            before = held[-1:] and [held[-1].slice(held[-1].num_rows - 1)]
            starts = _starts(pa.Table.from_batches([*before, batch]), keys)
            cut = int(starts[-1]) - len(before)  # where the batch's last series begins, under 0 if it is the one before
            if cut < 0:
                held.append(batch)
                continue
            whole = pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            if whole.num_rows:
                yield from work(whole, _starts(whole, keys))
            held = [batch.slice(cut)]
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks(), np.zeros(1, np.int64))

    return dealt(rows, keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, schema)
