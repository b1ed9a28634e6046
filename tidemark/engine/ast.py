"""Syntax trees. Expressions compare by structure, which the analyzer uses to find grouping keys."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


class Expr:
    pass


@dataclass(frozen=True)
class Column(Expr):
    qualifier: str | None
    name: str


@dataclass(frozen=True)
class Literal(Expr):
    value: Any
    type: str  # int float text bool null


@dataclass(frozen=True)
class Param(Expr):
    index: int


@dataclass(frozen=True)
class Incoming(Expr):
    """The value that an upsert would have inserted."""

    name: str


@dataclass(frozen=True)
class Binary(Expr):
    op: str  # + - * / = != < <= > >= AND OR
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # NOT - +
    expr: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    expr: Expr
    negated: bool


@dataclass(frozen=True)
class Like(Expr):
    expr: Expr
    pattern: Expr
    negated: bool


@dataclass(frozen=True)
class InList(Expr):
    expr: Expr
    items: tuple[Expr, ...]
    negated: bool


@dataclass(frozen=True)
class InQuery(Expr):
    expr: Expr
    query: Query
    negated: bool


@dataclass(frozen=True)
class Exists(Expr):
    query: Query
    negated: bool


@dataclass(frozen=True)
class Scalar(Expr):
    query: Query


@dataclass(frozen=True)
class Aggregate(Expr):
    function: str  # count sum avg min max
    expr: Expr | None
    distinct: bool


@dataclass(frozen=True)
class Star:
    qualifier: str | None


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None


@dataclass(frozen=True)
class Derived:
    query: Query
    alias: str


@dataclass(frozen=True)
class Join:
    kind: str  # inner left right cross
    source: TableRef | Derived
    on: Expr | None


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool


@dataclass(frozen=True)
class Cte:
    name: str
    columns: tuple[str, ...]
    query: Query


@dataclass(frozen=True)
class Query:
    items: tuple[Star | Item, ...]
    source: TableRef | Derived | None = None
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    distinct: bool = False
    ctes: tuple[Cte, ...] = ()


@dataclass
class ColumnDef:
    name: str
    type: str
    nullable: bool = True
    default: Literal | None = None
    #: Primary key, unique, checks and references that stand beside the column.
    inline: list = field(default_factory=list)


@dataclass
class Constraint:
    kind: str  # primary unique check foreign
    columns: list[str]
    name: str | None = None
    check: Expr | None = None
    ref_table: str | None = None
    ref_columns: list[str] = field(default_factory=list)


class Statement:
    pass


@dataclass
class Select(Statement):
    query: Query


@dataclass
class CreateTable(Statement):
    table: str
    columns: list[ColumnDef]
    constraints: list[Constraint]
    if_not_exists: bool


@dataclass
class DropTable(Statement):
    table: str
    if_exists: bool


@dataclass
class CreateIndex(Statement):
    name: str
    table: str
    columns: list[str]
    unique: bool
    if_not_exists: bool


@dataclass
class DropIndex(Statement):
    name: str
    table: str
    if_exists: bool


@dataclass
class AlterTable(Statement):
    table: str
    operations: list[tuple]


@dataclass
class Insert(Statement):
    table: str
    columns: list[str] | None
    rows: list[list[Expr]] | None
    query: Query | None
    on_duplicate: list[tuple[str, Expr]]


@dataclass
class Update(Statement):
    table: str
    assignments: list[tuple[str, Expr]]
    where: Expr | None


@dataclass
class Delete(Statement):
    table: str
    where: Expr | None


@dataclass
class Begin(Statement):
    pass


@dataclass
class Commit(Statement):
    pass


@dataclass
class Rollback(Statement):
    pass


@dataclass
class SetVariable(Statement):
    name: str
    value: Literal


@dataclass
class Prepare(Statement):
    name: str
    text: str | None
    variable: str | None


@dataclass
class Execute(Statement):
    name: str
    variables: list[str]


@dataclass
class Deallocate(Statement):
    name: str


@dataclass
class ShowTables(Statement):
    pass


@dataclass
class ShowIndexes(Statement):
    table: str


@dataclass
class Describe(Statement):
    table: str


@dataclass
class Explain(Statement):
    statement: Statement


def rewrite(node: Any, change, into_queries: bool = True) -> Any:
    """``node`` with every expression replaced by ``change(expr)``, from the leaves up; change may return its argument."""
    if isinstance(node, (list, tuple)):
        new = [rewrite(x, change, into_queries) for x in node]
        if all(a is b for a, b in zip(new, node, strict=True)):
            return node
        return type(node)(new)
    if is_dataclass(node):
        if isinstance(node, Query) and not into_queries:
            return node
        updates = {}
        for f in fields(node):
            old = getattr(node, f.name)
            new = rewrite(old, change, into_queries)
            if new is not old:
                updates[f.name] = new
        node = replace(node, **updates) if updates else node
        return change(node) if isinstance(node, Expr) else node
    return node


def replace_top(node: Any, find) -> Any:
    """``node`` with the outermost expressions for which ``find`` returns something replaced by it; not into queries."""
    if isinstance(node, tuple):
        return tuple(replace_top(x, find) for x in node)
    if isinstance(node, Query) or not is_dataclass(node):
        return node
    if isinstance(node, Expr) and (new := find(node)) is not None:
        return new
    updates = {f.name: replace_top(getattr(node, f.name), find) for f in fields(node)}
    return replace(node, **updates)


def walk(node: Any, into_queries: bool = True):
    """Every expression in ``node``, outermost first."""
    if isinstance(node, (list, tuple)):
        for x in node:
            yield from walk(x, into_queries)
    elif is_dataclass(node):
        if isinstance(node, Expr):
            yield node
        if isinstance(node, Query) and not into_queries:
            return
        for f in fields(node):
            yield from walk(getattr(node, f.name), into_queries)


def to_json(node: Any) -> Any:
    """An expression as JSON values."""
    if isinstance(node, (list, tuple)):
        return [to_json(x) for x in node]
    if is_dataclass(node):
        return {"_": type(node).__name__} | {f.name: to_json(getattr(node, f.name)) for f in fields(node)}
    return node


def from_json(value: Any) -> Any:
    """The expression that :func:`to_json` wrote."""
    if isinstance(value, list):
        return tuple(from_json(x) for x in value)
    if isinstance(value, dict):
        kind = globals()[value["_"]]
        if not (isinstance(kind, type) and is_dataclass(kind)):
            raise ValueError(value["_"])
        return kind(**{k: from_json(v) for k, v in value.items() if k != "_"})
    return value
