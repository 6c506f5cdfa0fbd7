"""Cell and feature filters: thresholds, boolean expressions, range and set masks."""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celloom.operators.stats import ranks

_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


def parse_mask(text: str, columns: list[str]) -> Column:
    """A boolean expression over columns: and, or, not, &, |, ~, comparisons (chained too), in, not in, .isin([...]), .between(a, b).

    Nulls follow SQL: a comparison with one selects nothing.
    """

    def value(node: ast.AST) -> Column:
        if isinstance(node, ast.Name):
            if node.id not in columns:
                raise KeyError(f"unknown column {node.id}")
            return F.col(node.id)
        return F.lit(constant(node))

    def constant(node: ast.AST):
        try:
            return ast.literal_eval(node)
        except ValueError:
            raise ValueError(f"not supported in a mask: {ast.unparse(node)}") from None

    def test(node: ast.AST) -> Column:
        match node:
            case ast.BoolOp():
                return reduce(operator.and_ if isinstance(node.op, ast.And) else operator.or_, map(test, node.values))
            case ast.BinOp(op=ast.BitAnd()):
                return test(node.left) & test(node.right)
            case ast.BinOp(op=ast.BitOr()):
                return test(node.left) | test(node.right)
            case ast.UnaryOp(op=ast.Not() | ast.Invert()):
                return ~test(node.operand)
            case ast.Constant(value=bool()):
                return F.lit(node.value)
            case ast.Name():
                return value(node).cast("boolean")
            case ast.Call(func=ast.Attribute(attr="isin")):
                return value(node.func.value).isin(list(constant(node.args[0])))
            case ast.Call(func=ast.Attribute(attr="between")):
                return value(node.func.value).between(*map(constant, node.args))
            case ast.Compare():
                sides, out = [node.left, *node.comparators], []
                for op, left, right in zip(node.ops, sides, sides[1:], strict=False):
                    if isinstance(op, ast.In | ast.NotIn):
                        found = value(left).isin(list(constant(right)))
                        out.append(found if isinstance(op, ast.In) else ~found)
                    elif type(op) in _COMPARE:
                        out.append(_COMPARE[type(op)](value(left), value(right)))
                    else:
                        raise ValueError(f"not supported in a mask: {ast.unparse(node)}")
                return reduce(operator.and_, out)
        raise ValueError(f"not supported in a mask: {ast.unparse(node)}")

    return test(ast.parse(text.strip(), mode="eval").body)


def dict_mask(mask: dict, columns: list[str]) -> Column:
    """A pair is an inclusive range with None for an open end, a list, set or array a choice, a scalar an equality; all must hold."""
    out = F.lit(True)
    for name, want in mask.items():
        if name not in columns:
            raise KeyError(f"unknown column {name}")
        c = F.col(name)
        want = want.tolist() if isinstance(want, np.ndarray | np.generic) else want
        if isinstance(want, tuple) and len(want) == 2 and any(x is not None for x in want) and all(x is None or isinstance(x, int | float | np.number) for x in want):
            want = tuple(x.item() if isinstance(x, np.generic) else x for x in want)
            for bound, op in zip(want, (operator.ge, operator.le), strict=True):
                out = out if bound is None else out & op(c, F.lit(bound))
        else:
            out &= c.isin(list(want)) if isinstance(want, list | set | tuple) else c == F.lit(want)
    return out


def filter_cells(entries: DataFrame, cells: DataFrame, min_counts=None, max_counts=None, min_features=None, max_features=None, mask: str | dict | Callable[[DataFrame], Column] | np.ndarray | list | None = None, required: bool = False) -> DataFrame:
    """The cells within all thresholds (inclusive) that the mask selects; cells without entries count as empty.

    A mask is an expression, a dict, a function from the cells to a boolean Column, an array of booleans, one a cell in ascending
    order of cell, or an array of places in that order. An array of booleans of another length raises. With required, so do no
    surviving cells.
    """
    stats = entries.groupBy("cell").agg(F.sum("x").alias("__counts"), F.sum((F.col("x") != 0).cast("long")).alias("__features"))
    held = cells.join(stats, "cell", "left").fillna(0, ["__counts", "__features"])
    for name, low, high in (("__counts", min_counts, max_counts), ("__features", min_features, max_features)):
        held = held if low is None else held.where(F.col(name) >= low)
        held = held if high is None else held.where(F.col(name) <= high)
    if isinstance(mask, np.ndarray | list):
        held, mask = _by_place(held, np.asarray(mask)), None
    if mask is not None:
        test = parse_mask(mask, cells.columns) if isinstance(mask, str) else dict_mask(mask, cells.columns) if isinstance(mask, dict) else mask(held)
        held = held.where(test)
    out = held.select(cells.columns)
    if required and not out.limit(1).count():
        raise ValueError("no cell passes the filter")
    return out


def _by_place(cells: DataFrame, mask: np.ndarray) -> DataFrame:
    """The cells at the places that an array gives, the places being those of all cells in ascending order."""
    n = cells.count()
    if mask.dtype == bool:
        if len(mask) != n:
            raise ValueError(f"{len(mask)} booleans for {n} cells")
        mask = np.flatnonzero(mask)
    if len(mask) and (mask.min() < -n or mask.max() >= n):
        raise IndexError(f"places of {n} cells are from 0 to {n - 1}")
    wanted = cells.sparkSession.createDataFrame(pa.table({"__place": np.unique(mask.astype(np.int64) % max(n, 1))}))
    ranked = ranks(cells, "cell", F.lit(1)).select("cell", F.col("below0").alias("__place"))
    return cells.join(ranked.join(wanted, "__place", "left_semi").select("cell"), "cell", "left_semi")


def filter_features(entries: DataFrame, features: DataFrame, min_cells=None, max_cells=None, min_counts=None, max_counts=None) -> DataFrame:
    stats = entries.groupBy("feat").agg(F.sum("x").alias("__counts"), F.sum((F.col("x") != 0).cast("long")).alias("__cells"))
    held = features.join(stats, "feat", "left").fillna(0, ["__counts", "__cells"])
    for name, low, high in (("__cells", min_cells, max_cells), ("__counts", min_counts, max_counts)):
        held = held if low is None else held.where(F.col(name) >= low)
        held = held if high is None else held.where(F.col(name) <= high)
    return held.select(features.columns)
