"""Static check of an expression's price scale: does it mix adjusted price levels with raw turnover?

Adjusted prices of an entity are known up to a factor, raw turnover isn't scaled with them. A tree is read once from its leaves; each node says whether it
holds a price, whether it holds turnover, and whether its value stays the same when all prices of an entity are scaled. A node over both kinds
that doesn't stay the same measures the adjustment, not the market.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.expression import ExpressionError, Node, parse

#: Fields known up to a factor, fields of raw turnover, and functions whose value doesn't change with the scale of a price.
PRICES, TURNOVER = frozenset(("open", "high", "low", "close")), frozenset(("amount",))
SCALE_FREE = frozenset(("ts_corr", "ts_corr_v2", "ts_rank", "sign", "returns", "ts_robust_zscore", "ts_drawdown"))
VERDICT = T.StructType([T.StructField("status", T.StringType()), T.StructField("scale_free", T.BooleanType()), T.StructField("mixed", T.ArrayType(T.StringType())), T.StructField("fields", T.ArrayType(T.StringType()))])


@dataclass(frozen=True)
class Scale:
    """What is known of a node's value."""

    price: bool
    turnover: bool
    free: bool


def scale_of(node: Node, found: list[str]) -> Scale:
    """Scale of a node; texts of mixed nodes below and at it are added to found, the innermost first."""
    if node.kind == "number":
        return Scale(False, False, True)
    if node.kind == "field":
        return Scale(node.name in PRICES, node.name in TURNOVER, node.name not in PRICES)
    parts = [scale_of(a, found) for a in node.args]
    price, turnover = any(p.price for p in parts), any(p.turnover for p in parts)
    priced = [p for p in parts if p.price]
    if not price:
        free = True
    elif node.kind == "/" and len(priced) == 2 or node.kind == "call" and node.name in SCALE_FREE:
        free = True  # a ratio of prices; a function that removes the scale
    elif node.kind in ("+", "-", "*", "/") and len(priced) == 2:
        free = False
    else:
        free = all(p.free for p in priced)
    if node.kind not in ("negate",) and price and turnover and not free:
        found.append(node.text())
    return Scale(price, turnover, free)


def audit(text: str, fields) -> tuple[str, bool | None, list[str], list[str]]:
    """VERDICT of one expression: ok or mixed, or why it isn't an expression."""
    try:
        node = parse(text, fields)
    except ExpressionError as e:
        return f"error: {e}", None, [], []
    found: list[str] = []
    scale = scale_of(node, found)
    return "mixed" if found else "ok", scale.free, found, sorted({n.name for n in node.walk() if n.kind == "field"})


def audited(rows: DataFrame, column: str, fields) -> DataFrame:
    """rows with verdict, the audit of the expression in a column. A null is no expression."""
    allowed = tuple(fields)

    @F.pandas_udf(VERDICT)
    def verdict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([audit(t or "", allowed) for t in texts], columns=VERDICT.names)

    return rows.withColumn("verdict", verdict(F.col(column)))
