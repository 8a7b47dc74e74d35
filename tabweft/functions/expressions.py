"""Boolean and arithmetic row expressions, as data-frame libraries write them, as Spark columns."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}


def translate(text: str) -> Column:
    """``a >= 18 and (b > c) | ~d``, chained comparisons, ``**``, ``%``, ``//`` and ``in [..]``; ValueError for anything else.

    A comparison with a missing value is false, ``!=`` and ``not in`` are true.
    """
    try:
        return _column(ast.parse(text.strip(), mode="eval").body)
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text!r}") from e


def _column(x: ast.AST) -> Column:
    if isinstance(x, ast.Name):
        return F.col(x.id)
    if isinstance(x, ast.Constant):
        return F.lit(x.value)
    if isinstance(x, ast.BoolOp):
        out = _column(x.values[0])
        for v in x.values[1:]:
            out = out & _column(v) if isinstance(x.op, ast.And) else out | _column(v)
        return out
    if isinstance(x, ast.UnaryOp):
        inner = _column(x.operand)
        return ~inner if isinstance(x.op, (ast.Not, ast.Invert)) else -inner if isinstance(x.op, ast.USub) else inner
    if isinstance(x, ast.BinOp):
        a, b = _column(x.left), _column(x.right)
        match x.op:
            case ast.Add():
                return a + b
            case ast.Sub():
                return a - b
            case ast.Mult():
                return a * b
            case ast.Div():
                return F.try_divide(a, b)
            case ast.FloorDiv():
                return F.floor(F.try_divide(a, b))
            case ast.Mod():  # the sign of the divisor, as in Python
                return a - b * F.floor(F.try_divide(a, b))
            case ast.Pow():
                return F.pow(a, b)
            case ast.BitAnd():
                return a & b
            case ast.BitOr():
                return a | b
    if isinstance(x, ast.Compare):
        out, left = None, x.left
        for op, right in zip(x.ops, x.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)) and isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                one = _column(left).isin(*[v.value for v in right.elts])
                one = ~one if isinstance(op, ast.NotIn) else one
            elif type(op) in _COMPARE:
                one = getattr(_column(left), _COMPARE[type(op)])(_column(right))
            else:
                raise ValueError("unknown comparison")
            one = F.coalesce(one, F.lit(isinstance(op, (ast.NotEq, ast.NotIn))))
            out, left = one if out is None else out & one, right
        return out
    raise ValueError(f"cannot translate {ast.dump(x)}")
