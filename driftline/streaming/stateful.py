"""Structured Streaming: online and chunked smoothing with state per key.

State is bounded by the configuration: the window of the online smoother, or one chunk and its overlap.
Rows of a micro-batch are taken in the order of ``order_by``; across micro-batches arrival counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftline.config import SmootherConfig
from driftline.operators.numeric import merged, smooth
from driftline.operators.online import online_rows


def online_stream(df: DataFrame, key: str, x: list[str], y: str, c: SmootherConfig, order_by: str, reset: str | None = None) -> DataFrame:
    """key, order, y, y_smooth, residual, rob_weight, iterations_used, window_rows for every arriving row.

    A row whose boolean column ``reset`` is true empties the window before it.
    """
    d = c.dimensions
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    made_here = ["y_smooth", "residual", "rob_weight", "iterations_used", "window_rows"]

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        xs, ys = (np.array(v, np.float64) for v in (state.get if state.exists else ([], [])))
        pdf = pd.concat(list(parts)).sort_values(order_by, kind="stable").reset_index(drop=True)
        old = len(ys)
        xs, ys = np.concatenate([xs.reshape(-1, d), pdf[x].to_numpy(np.float64)]), np.r_[ys, pdf[y].to_numpy(np.float64)]
        place = np.arange(len(ys))
        fresh = np.r_[np.zeros(old, bool), pdf[reset].astype(bool)] if reset else np.zeros(len(ys), bool)
        begin = np.maximum.accumulate(np.where(fresh, place, 0))
        rows = online_rows(xs, ys, np.where(place < old, -1, place - begin), c)
        first = max(int(begin[-1]), len(ys) - c.window_capacity)
        state.update((xs[first:].ravel().tolist(), ys[first:].tolist()))
        out = pd.DataFrame({key: group[0], order_by: pdf[order_by], "y": ys[old:], **{k: rows[k][old:] for k in made_here}})
        yield out.astype({"iterations_used": "Int32", "window_rows": "Int32"})

    schema = f"{key} {fields[key]}, {order_by} {fields[order_by]}, y double, y_smooth double, residual double, rob_weight double, iterations_used int, window_rows int"
    return df.groupBy(key).applyInPandasWithState(run, schema, "xs array<double>, ys array<double>", "append", GroupStateTimeout.NoTimeout)


class ChunkState:
    """Pending rows and the carried overlap of one series."""

    def __init__(self, c: SmootherConfig, place: list, xs: list, ys: list, carried: int, fits: list, weights: list):
        self.c, self.place, self.x, self.y = c, list(place), list(xs), list(ys)
        self.carried, self.fits, self.weights = carried, list(fits), list(weights)

    def values(self) -> tuple:
        return self.place, self.x, self.y, self.carried, self.fits, self.weights

    def block(self, rows: int, last: bool) -> list[tuple]:
        """Fit the carried rows and ``rows`` new ones; give out all but the new overlap, or all if it is the last."""
        c, n = self.c, self.carried + rows
        x = np.array(self.x[: n * c.dimensions], np.float64).reshape(n, c.dimensions)
        y = np.array(self.y[:n], np.float64)
        if n > 1:
            fit = smooth(x, y, c)
            values, weights = fit.y, fit.weights
        else:
            values, weights = y, np.ones(n)
        told, told_w = values.copy(), weights.copy()
        k = self.carried
        told[:k] = merged(np.array(self.fits), values[:k], c.merge_strategy)
        told_w[:k] = merged(np.array(self.weights), weights[:k], c.merge_strategy)
        keep = 0 if last else min(c.overlap, n)
        give = n - keep
        out = list(zip(self.place[:give], y[:give], told[:give], y[:give] - told[:give], told_w[:give], strict=True))
        self.place, self.x, self.y = self.place[give:], self.x[give * c.dimensions :], self.y[give:]
        self.carried, self.fits, self.weights = keep, values[give:].tolist(), weights[give:].tolist()
        return out

    def ready(self) -> list[tuple]:
        """Rows of all blocks that can be fitted while a full overlap is left for the next."""
        out = []
        while len(self.y) - self.carried >= self.c.chunk_size + max(self.c.overlap, 1):
            out += self.block(self.c.chunk_size, False)
        return out

    def flush(self) -> list[tuple]:
        """The rest, as one last block; only the carried rows if nothing new has come."""
        new = len(self.y) - self.carried
        return self.block(new, True) if new else list(zip(self.place, self.y, self.fits, (np.array(self.y) - np.array(self.fits)).tolist(), self.weights, strict=True))


def chunk_stream(df: DataFrame, key: str, x: list[str], y: str, c: SmootherConfig, order_by: str, end: str | None = None, timeout_ms: int | None = None, reset: str | None = None) -> DataFrame:
    """key, order, y, y_smooth, residual, rob_weight as blocks fill up.

    A series ends with a row whose boolean column ``end`` is true (its values are not used), or after
    ``timeout_ms`` of processing time without rows; then the rest is given out and its state dropped. A row whose
    boolean column ``reset`` is true begins anew: what waits is given out before it, and nothing is carried over to it.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [key, order_by, "y", "y_smooth", "residual", "rob_weight"]

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = ChunkState(c, *(state.get if state.exists else ([], [], [], 0, [], [])))
        out = []
        if state.hasTimedOut:
            out = own.flush()
            state.remove()
        else:
            pdf = pd.concat(list(parts)).sort_values(order_by, kind="stable")
            over = bool(end) and bool(pdf[end].any())
            new = pdf[~pdf[end].astype(bool)] if end else pdf
            begins = np.flatnonzero(new[reset].astype(bool)).tolist() if reset else []
            for first, after in zip([0, *begins], [*begins, len(new)], strict=True):
                if first in begins:
                    out += own.flush()
                    own = ChunkState(c, [], [], [], 0, [], [])
                part = new.iloc[first:after]
                own.place += part[order_by].tolist()
                own.x += part[x].to_numpy(np.float64).ravel().tolist()
                own.y += part[y].astype(float).tolist()
                out += own.ready()
            if over:
                out += own.flush()
                if state.exists:
                    state.remove()
            else:
                state.update(own.values())
                if timeout_ms:
                    state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(group[0], *row) for row in out], columns=names)

    place = fields[order_by]
    states = f"place array<{place}>, xs array<double>, ys array<double>, carried int, fits array<double>, weights array<double>"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(run, f"{key} {fields[key]}, {order_by} {place}, y double, y_smooth double, residual double, rob_weight double", states, "append", timeout)
