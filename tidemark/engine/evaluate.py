"""Expressions over one row in Python: for constants and for the small batches that a conflict forces onto the driver."""

from __future__ import annotations

import re
from typing import Any

from tidemark.engine import ast as A
from tidemark.engine.errors import AnalysisError, ExecutionError
from tidemark.engine.types import NUMERIC, value_type


def truth(v: Any) -> bool | None:
    return None if v is None else bool(v)


def compare(op: str, a: Any, b: Any) -> bool | None:
    if a is None or b is None:
        return None
    ka, kb = value_type(a), value_type(b)
    if ka != kb and not (ka in NUMERIC and kb in NUMERIC):
        return op == "!="
    if ka == "text":
        a, b = a.encode(), b.encode()
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def like(text: str, pattern: str) -> bool:
    parts = (".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return re.fullmatch("".join(parts), text, re.I | re.S) is not None


def arithmetic(op: str, a: Any, b: Any) -> Any:
    for v in (a, b):
        if v is not None and value_type(v) not in NUMERIC:
            raise AnalysisError("Arithmetic requires numeric values")
    if a is None or b is None:
        return None
    if op == "/":
        if b == 0:
            raise ExecutionError("Division by zero")
        if isinstance(a, int) and isinstance(b, int):
            q = abs(a) // abs(b)
            return q if (a < 0) == (b < 0) else -q
        return a / b
    out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[op]()
    if isinstance(out, int) and not -(2**63) <= out < 2**63:
        raise ExecutionError("integer out of range")
    return out


def evaluate(e: A.Expr, row: dict[str, Any] | None = None, incoming: dict[str, Any] | None = None) -> Any:
    """The value of an expression without subqueries and aggregates."""
    ev = lambda x: evaluate(x, row, incoming)
    match e:
        case A.Literal():
            return e.value
        case A.Column():
            if row is None or e.name not in row:
                raise AnalysisError(f"Unknown column '{e.name}'")
            return row[e.name]
        case A.Incoming():
            if incoming is None or e.name not in incoming:
                raise AnalysisError(f"VALUES({e.name}) stands only in ON DUPLICATE KEY UPDATE")
            return incoming[e.name]
        case A.Unary(op="NOT"):
            t = truth(ev(e.expr))
            return None if t is None else not t
        case A.Unary():
            return arithmetic("*", ev(e.expr), -1 if e.op == "-" else 1)
        case A.Binary(op="AND"):
            a, b = truth(ev(e.left)), truth(ev(e.right))
            return False if a is False or b is False else None if a is None or b is None else True
        case A.Binary(op="OR"):
            a, b = truth(ev(e.left)), truth(ev(e.right))
            return True if a or b else None if a is None or b is None else False
        case A.Binary(op="+" | "-" | "*" | "/"):
            return arithmetic(e.op, ev(e.left), ev(e.right))
        case A.Binary():
            return compare(e.op, ev(e.left), ev(e.right))
        case A.IsNull():
            return (ev(e.expr) is None) != e.negated
        case A.Like():
            a, p = ev(e.expr), ev(e.pattern)
            if a is None or p is None:
                return None
            return (isinstance(a, str) and isinstance(p, str) and like(a, p)) != e.negated
        case A.InList():
            a = ev(e.expr)
            hits = [compare("=", a, ev(x)) for x in e.items]
            found = True if True in hits else None if None in hits else False
            return None if found is None else found != e.negated
    raise AnalysisError("a subquery, aggregate or parameter cannot stand here")
