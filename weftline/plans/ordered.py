"""Many expressions over an entity's history in one pass: Spark shuffles by entity and sorts, tasks go through batches of sorted rows.

`factors` asks Spark for a window of each sub-expression, and a sliding window adds up its rows anew for each row. Here a batch is a few columns of numbers,
windows are merged from halves of halves, and only the rows that the next batch looks back on are kept, so memory doesn't grow with an entity. It takes
functions of rows and the functions of time in KERNELS; values that aren't numbers count as missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.catalog import FUNCTIONS, LOG_TINY, TINY
from weftline.plans.compiler import CLEANED
from weftline.plans.expression import ExpressionError, Node, parse, required_history
from weftline.sources.panel import KEY


def shifted(x: np.ndarray, k: int) -> np.ndarray:
    """x of k rows before."""
    out = np.full(len(x), np.nan)
    if k < len(x):
        out[k:] = x[: len(x) - k]
    return out


def rolled(state: tuple[np.ndarray, ...], w: int, merge: Callable) -> tuple[np.ndarray, ...]:
    """States of the last w rows from those of single rows. merge(older, rows, newer, rows)."""
    found, size, block, length = None, 0, state, 1
    while True:
        if w & length:
            found = block if found is None else merge(tuple(shifted(b, size) for b in block), length, found, size)
            size += length
        if 2 * length > w:
            return found
        block = merge(tuple(shifted(b, length) for b in block), length, block, length)
        length *= 2


def moments(a, m, b, n):
    """Means and sums of squared deviations of two stretches together."""
    d = b[0] - a[0]
    return a[0] + d * (n / (m + n)), a[1] + b[1] + d * d * (m * n / (m + n))


def products(a, m, b, n):
    """Two means and sums of products of deviations of two stretches together."""
    d, e = b[0] - a[0], b[1] - a[1]
    return a[0] + d * (n / (m + n)), a[1] + e * (n / (m + n)), a[2] + b[2] + d * e * (m * n / (m + n))


def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


class Batch:
    """Values of expressions on rows in order; row: place in the entity's history, from 0."""

    def __init__(self, fields: dict[str, np.ndarray], row: np.ndarray):
        self.fields, self.row, self.kept = fields, row, {}

    def value(self, node: Node) -> np.ndarray:
        if node not in self.kept:
            self.kept[node] = self.found(node)
        return self.kept[node]

    def found(self, node: Node) -> np.ndarray:
        if node.kind == "number":
            return np.full(len(self.row), node.value)
        if node.kind == "field":
            return self.fields[node.name]
        x, *more = (self.value(a) for a in node.args)
        if node.kind != "call":
            return {"negate": lambda: -x, "+": lambda: x + more[0], "-": lambda: x - more[0], "*": lambda: x * more[0], "/": lambda: share(x, more[0] + TINY)}[node.kind]()
        if node.name in ROWS:
            return ROWS[node.name](x, *more)
        w = int(node.literals[0])
        return np.where(self.row >= w - 1 + FUNCTIONS[node.name].reach, KERNELS[node.name](self, node, w), np.nan)

    def once(self, kind: str, nodes: tuple[Node, ...], w: int, make: Callable):
        key = (kind, nodes, w)
        if key not in self.kept:
            self.kept[key] = make()
        return self.kept[key]

    def own(self, node: Node, name: str) -> np.ndarray:
        x = self.value(node)
        return np.where(np.isfinite(x), x, np.nan) if name in CLEANED else x

    def moments(self, x: Node, w: int):
        return self.once("moments", (x,), w, lambda: rolled((self.value(x), np.where(np.isnan(self.value(x)), np.nan, 0.0)), w, moments))

    def line(self, x: Node, w: int) -> np.ndarray:
        """Sum of products of deviations of x and of time."""
        return self.once("line", (x,), w, lambda: rolled((self.value(x), np.arange(len(self.row), dtype=float), np.where(np.isnan(self.value(x)), np.nan, 0.0)), w, products)[2])

    def most(self, x: Node, w: int, merge: Callable) -> np.ndarray:
        return self.once(merge.__name__, (x,), w, lambda: rolled((self.value(x),), w, lambda a, m, b, n: (merge(a[0], b[0]),))[0])

    def frames(self, x: Node, w: int, of: Callable) -> np.ndarray:
        """of(rows by w values) where all w are there."""
        values, out = self.value(x), np.full(len(self.row), np.nan)
        if len(values) >= w:
            seen = np.cumsum(np.concatenate([[0], np.isnan(values)]))
            out[w - 1 :] = np.where(seen[w:] == seen[:-w], of(sliding_window_view(values, w)), np.nan)
        return out


def quantile(b: Batch, node: Node, w: int) -> np.ndarray:
    place = node.literals[1] * (w - 1)
    low = int(place)
    high = min(low + 1, w - 1)

    def of(frames):
        parts = np.partition(frames, [low, high], axis=1)
        return parts[:, low] + (parts[:, high] - parts[:, low]) * (place - low)

    return b.frames(node.args[0], w, of)


def rank(b: Batch, node: Node, w: int) -> np.ndarray:
    x = b.value(node.args[0])

    def of(frames):
        count = np.zeros(len(frames))
        for k in range(w):
            count += frames[:, k] <= frames[:, -1]
        return count / w

    return b.frames(node.args[0], w, of) if len(x) else x


def correlation(b: Batch, node: Node, w: int) -> np.ndarray:
    x, y = (b.own(a, node.name) for a in node.args)
    both = np.isfinite(x) & np.isfinite(y)
    x, y, zero = np.where(both, x, np.nan), np.where(both, y, np.nan), np.where(both, 0.0, np.nan)
    spread = np.sqrt(rolled((x, zero), w, moments)[1] / w) * np.sqrt(rolled((y, zero), w, moments)[1] / w)
    return np.clip(share(rolled((x, y, zero), w, products)[2] / w, spread), -1, 1)


def slope(b: Batch, x: Node, w: int) -> np.ndarray:
    return b.line(x, w) / (w * (w * w - 1) / 12 + TINY)


def rsquare(b: Batch, node: Node, w: int) -> np.ndarray:
    line = b.line(node.args[0], w)
    return share(line * line, w * (w * w - 1) / 12 * b.moments(node.args[0], w)[1] + TINY)


def compared(test: Callable) -> Callable:
    return lambda x, y: np.where(np.isnan(x) | np.isnan(y), np.nan, test(x, y))


ROWS: dict[str, Callable] = {
    "log": lambda x: np.log(np.abs(x) + LOG_TINY), "abs": np.abs, "sign": np.sign, "maximum": np.fmax, "minimum": np.fmin, "gt": compared(np.greater), "lt": compared(np.less),
}
KERNELS: dict[str, Callable[[Batch, Node, int], np.ndarray]] = {
    "delay": lambda b, n, w: shifted(b.value(n.args[0]), w),
    "ts_mean": lambda b, n, w: b.moments(n.args[0], w)[0],
    "ts_std": lambda b, n, w: np.sqrt(b.moments(n.args[0], w)[1] / (w - 1)) if w > 1 else np.full(len(b.row), np.nan),
    "ts_sum": lambda b, n, w: rolled((b.value(n.args[0]),), w, lambda a, _, c, __: (a[0] + c[0],))[0],
    "ts_max": lambda b, n, w: b.most(n.args[0], w, np.maximum),
    "ts_min": lambda b, n, w: b.most(n.args[0], w, np.minimum),
    "ts_quantile": quantile,
    "ts_rank": rank,
    "ts_argmax": lambda b, n, w: b.frames(n.args[0], w, lambda f: f.argmax(axis=1) + 1.0),
    "ts_argmin": lambda b, n, w: b.frames(n.args[0], w, lambda f: f.argmin(axis=1) + 1.0),
    "ts_slope": lambda b, n, w: slope(b, n.args[0], w),
    "ts_rsquare": rsquare,
    "ts_resi": lambda b, n, w: b.value(n.args[0]) - b.moments(n.args[0], w)[0] - slope(b, n.args[0], w) * ((w - 1) / 2),
    "ts_corr_v2": correlation,
}


def evaluated(batches: Iterator[pa.RecordBatch], nodes: dict[str, Node]) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
    """Each batch of sorted rows with the values of the expressions on its rows."""
    fields = sorted({n.name for node in nodes.values() for n in node.walk() if n.kind == "field"})
    need = max([required_history(n) for n in nodes.values()], default=0)
    before, first = None, 0  # rows handed on, and the place of the first of them
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.select(["ts_code", *fields])
        table = pa.Table.from_batches([own] if before is None else [*before, own])
        codes = pc.dictionary_encode(table["ts_code"].combine_chunks(), null_encoding="encode").indices.to_numpy()
        at = np.arange(len(codes))
        starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
        row = at - np.repeat(starts, np.diff(np.append(starts, len(codes))))
        row[: starts[1] if len(starts) > 1 else len(row)] += first
        values = Batch({c: table[c].cast(pa.float64()).to_numpy().astype(float) for c in fields}, row)
        old = len(codes) - batch.num_rows
        with np.errstate(all="ignore"):
            found = {name: values.value(node)[old:] for name, node in nodes.items()}
        yield batch, found
        keep = max(starts[-1], len(codes) - need)
        before, first = table.slice(keep).to_batches(), int(row[keep]) if keep < len(row) else 0
        if not before:
            before = None


def sorted_rows(panel: DataFrame, expressions: dict[str, str]) -> tuple[DataFrame, dict[str, Node]]:
    fields = [c for c, kind in panel.dtypes if c not in KEY and kind not in ("string", "date", "timestamp")]
    nodes = {name: parse(text, fields) for name, text in expressions.items()}
    if unknown := sorted({n.name for node in nodes.values() for n in node.walk() if n.kind == "call"} - set(ROWS) - set(KERNELS)):
        raise ExpressionError(f"not for rows in order: {', '.join(unknown)}")
    return panel.repartition("ts_code").sortWithinPartitions(*KEY), nodes


def ordered_factors(panel: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """The panel with one column for each named expression, as `factors` gives it."""
    rows, nodes = sorted_rows(panel, expressions)

    def run(batches):
        for batch, found in evaluated(batches, nodes):
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, from_pandas=True) for v in found.values()]], names=[*batch.schema.names, *found])

    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kind}" for c, kind in panel.dtypes], *[f"`{name}` double" for name in nodes]]))


def value_summary(panel: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """feature, n, mean: number and mean of each expression's values. Tasks hand on counts and sums of batches."""
    rows, nodes = sorted_rows(panel, expressions)
    rows = rows.select("ts_code", *sorted({n.name for node in nodes.values() for n in node.walk() if n.kind == "field"}))

    def run(batches):
        for _, found in evaluated(batches, nodes):
            there = {name: v[~np.isnan(v)] for name, v in found.items()}
            yield pa.RecordBatch.from_pydict({"feature": list(there), "n": [len(v) for v in there.values()], "total": [float(v.sum()) for v in there.values()]})

    parts = rows.mapInArrow(run, "feature string, n long, total double").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return parts.select("feature", "n", F.try_divide("total", "n").alias("mean"))
