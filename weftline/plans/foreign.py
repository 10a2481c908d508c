"""Expression trees of another system, as JSON: read into this language's trees and written back, without approximation."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.expression import ExpressionError, Node, expression_hash, parse

#: Names of operators there and here. A windowed one has its window in the parameter named here.
BINARY = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}
UNARY = {"absolute": "abs", "cs_rank": "rank", "cs_zscore": "zscore"}
WINDOWED = {"delay": ("delay", "periods"), "delta": ("ts_delta", "periods"), "returns": ("returns", "periods"), "rolling_mean": ("ts_mean", "window"), "rolling_sum": ("ts_sum", "window"), "rolling_std": ("ts_std", "window"), "rolling_min": ("ts_min", "window"), "rolling_max": ("ts_max", "window"), "winsorize_mad": ("winsor_mad", "threshold")}
DEFAULTS = {"winsorize_mad": 3.0}
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
IMPORTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("error", T.StringType())])


def number(value) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value or abs(value) == float("inf"):
        raise ExpressionError(f"not a finite number: {value!r}")
    return float(value)


def plain(value: float) -> str:
    return str(int(value)) if value.is_integer() else repr(value)


def text_of(tree) -> str:
    """Text of a foreign tree; parse() then checks fields, windows and size."""
    if not isinstance(tree, dict) or not isinstance(tree.get("arguments") or [], list) or not isinstance(tree.get("parameters") or {}, dict):
        raise ExpressionError("a node is an object with a list of arguments and an object of parameters")
    operator, arguments, parameters = str(tree.get("operator") or ""), tree.get("arguments") or [], tree.get("parameters") or {}
    wanted = 2 if operator in BINARY else 0 if operator in ("field", "constant") else 1
    if operator not in {*BINARY, *UNARY, *WINDOWED, "negate", "field", "constant"}:
        raise ExpressionError(f"unknown operator {operator!r}")
    if len(arguments) != wanted:
        raise ExpressionError(f"{operator} takes {wanted} arguments")
    if operator == "field":
        if not NAME.match(name := str(parameters.get("name") or "")):
            raise ExpressionError(f"not a field's name: {name!r}")
        return name
    if operator == "constant":
        return plain(number(parameters.get("value")))
    inner = [text_of(a) for a in arguments]
    if operator in BINARY:
        return f"({inner[0]}{BINARY[operator]}{inner[1]})"
    if operator == "negate":
        return f"(-{inner[0]})"
    if operator in UNARY:
        return f"{UNARY[operator]}({inner[0]})"
    name, parameter = WINDOWED[operator]
    return f"{name}({inner[0]},{plain(number(parameters.get(parameter, DEFAULTS.get(operator))))})"


def tree_of(node: Node) -> dict:
    """The foreign tree of a node; functions that the other system lacks are refused."""
    if node.kind == "number":
        return {"operator": "constant", "arguments": [], "parameters": {"value": node.value}}
    if node.kind == "field":
        return {"operator": "field", "arguments": [], "parameters": {"name": node.name}}
    arguments = [tree_of(a) for a in node.args]
    if node.kind == "negate":
        return {"operator": "negate", "arguments": arguments, "parameters": {}}
    for there, here in BINARY.items():
        if node.kind == here:
            return {"operator": there, "arguments": arguments, "parameters": {}}
    for there, here in UNARY.items():
        if node.name == here:
            return {"operator": there, "arguments": arguments, "parameters": {}}
    for there, (here, parameter) in WINDOWED.items():
        if node.name == here and len(node.literals) == 1:
            return {"operator": there, "arguments": arguments, "parameters": {parameter: node.literals[0]}}
    raise ExpressionError(f"no operator for {node.name or node.kind}")


def imported(rows: DataFrame, column: str, fields) -> DataFrame:
    """rows with imported: text and hash of the tree in a JSON column, or why it was refused."""
    allowed = tuple(fields)

    def one(content: str | None) -> tuple:
        try:
            node = parse(text_of(json.loads(content or "")), allowed)
        except (ExpressionError, ValueError, RecursionError) as e:
            return None, None, str(e)
        return node.text(), expression_hash(node), None

    @F.pandas_udf(IMPORTED)
    def read(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(c) for c in contents], columns=IMPORTED.names)

    return rows.withColumn("imported", read(F.col(column)))
