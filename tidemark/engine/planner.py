"""From syntax trees to DataFrames.

Names are resolved against scopes of (qualifier, name); every attribute has a unique internal name in its DataFrame, so
self joins and repeated output names need no care. All rules of the dialect that Spark does not share (whole-number
division, truth of numbers and texts, comparison of unlike types, LIKE, bare columns, hidden sort keys) are settled
here with built-in expressions; the rest is left to Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.engine import ast as A
from tidemark.engine import types as K
from tidemark.engine.errors import AnalysisError

#: Marks a column that is resolved: its name is internal.
HERE = "#"


@dataclass(frozen=True)
class Attr:
    qualifier: str | None
    name: str
    column: str
    type: str


@dataclass
class Source:
    """A table as the planner sees it: its columns and what orders its rows, if anything does."""

    df: DataFrame
    row_order: list[str] | None = None
    hidden: tuple[str, ...] = ()


@dataclass
class Relation:
    df: DataFrame
    attrs: list[Attr]
    rows: list[str]


@dataclass
class Planned:
    df: DataFrame
    columns: list[str]
    names: list[str]
    types: list[str]

    def result(self) -> DataFrame:
        return self.df.toDF(*self.names)


def output_name(e: A.Expr) -> str:
    if isinstance(e, A.Column):
        return e.name
    if isinstance(e, A.Aggregate):
        return e.function
    return "subquery" if isinstance(e, (A.Scalar, A.Exists, A.InQuery)) else "expression"


def has_aggregate(node) -> bool:
    return any(isinstance(e, A.Aggregate) for e in A.walk(node, into_queries=False))


class Planner:
    """Plans queries over tables found by ``lookup(name)``."""

    def __init__(self, spark: SparkSession, lookup: Callable[[str], Source | None]):
        self.spark, self.lookup, self.count = spark, lookup, 0

    def fresh(self, kind: str) -> str:
        self.count += 1
        return f"__{kind}{self.count}"

    # -- FROM
    def relation(self, df: DataFrame, columns: list[tuple[str, str, str]], qualifier: str | None, order: list[str] | None, ordered: bool) -> Relation:
        """``df`` under internal names; columns are (name, column of df, type)."""
        attrs = [Attr(qualifier, n, self.fresh("c"), t) for n, _, t in columns]
        if not ordered and [c for _, c, _ in columns] == df.columns:
            return Relation(df.toDF(*[a.column for a in attrs]), attrs, [])
        out = [F.col(f"`{c}`").alias(a.column) for (_, c, _), a in zip(columns, attrs, strict=True)]
        rows: list[str] = []
        if ordered:
            rows = [self.fresh("r") for _ in (order or [""])]
            out += [F.col(f"`{c}`").alias(r) for c, r in zip(order, rows, strict=True)] if order else [F.monotonically_increasing_id().alias(rows[0])]
        return Relation(df.select(*out), attrs, rows)

    def source(self, s: A.TableRef | A.Derived, ctes: dict[str, Planned], ordered: bool) -> Relation:
        if isinstance(s, A.Derived):
            p, order = self.query(s.query, ctes), None
            alias = s.alias
        elif s.name in ctes:
            p, order, alias = ctes[s.name], None, s.alias or s.name
        else:
            found = self.lookup(s.name)
            if found is None:
                raise AnalysisError(f"Table '{s.name}' does not exist")
            columns = [(f.name.lower(), f.name, K.of_field(f.dataType)) for f in found.df.schema if f.name not in found.hidden]
            return self.relation(found.df, columns, s.alias or s.name, found.row_order, ordered)
        return self.relation(p.df, list(zip(p.names, p.columns, p.types, strict=True)), alias, order, ordered)

    def join(self, left: Relation, j: A.Join, ctes: dict[str, Planned], ordered: bool) -> Relation:
        right = self.source(j.source, ctes, ordered)
        if {a.qualifier for a in left.attrs} & {a.qualifier for a in right.attrs}:
            raise AnalysisError(f"Table name '{right.attrs[0].qualifier}' is used twice")
        attrs = [*left.attrs, *right.attrs]
        if j.kind == "cross":
            df = left.df.crossJoin(right.df)
        else:
            df = left.df.join(right.df, self.lowering(attrs, ctes).condition(self.resolved(j.on, attrs)), j.kind)
        return Relation(df, attrs, [*left.rows, *right.rows])

    # -- names
    def find(self, c: A.Column, attrs: list[Attr]) -> Attr:
        hits = [a for a in attrs if a.name == c.name and (c.qualifier is None or a.qualifier == c.qualifier)]
        shown = f"{c.qualifier}.{c.name}" if c.qualifier else c.name
        if len(hits) > 1:
            raise AnalysisError(f"Ambiguous column '{shown}'")
        if not hits:
            raise AnalysisError(f"Unknown column '{shown}'")
        return hits[0]

    def resolved(self, node, attrs: list[Attr]):
        """``node`` with its columns named internally; queries inside have scopes of their own."""
        change = lambda e: A.Column(HERE, self.find(e, attrs).column) if isinstance(e, A.Column) and e.qualifier != HERE else e
        return A.rewrite(node, change, into_queries=False)

    def resolves(self, node, attrs: list[Attr]) -> bool:
        try:
            self.resolved(node, attrs)
        except AnalysisError:
            return False
        return True

    def lowering(self, attrs: list[Attr], ctes: dict[str, Planned]) -> Lowering:
        return Lowering(self, {a.column: a.type for a in attrs}, ctes)

    # -- queries
    def query(self, q: A.Query, ctes: dict[str, Planned] | None = None) -> Planned:
        ctes = dict(ctes or {})
        for c in q.ctes:
            p = self.query(c.query, ctes)
            if c.columns and len(c.columns) != len(p.names):
                raise AnalysisError(f"CTE '{c.name}' names {len(c.columns)} columns and has {len(p.names)}")
            ctes[c.name] = Planned(p.df, p.columns, list(c.columns) or p.names, p.types)
        grouped = bool(q.group_by) or has_aggregate((q.items, q.having, q.order_by))
        if q.having is not None and not grouped:
            raise AnalysisError("HAVING without GROUP BY or an aggregate")
        if has_aggregate((q.where, q.group_by, [j.on for j in q.joins])):
            raise AnalysisError("an aggregate cannot stand in WHERE, ON or GROUP BY")
        rel = self.from_where(q, ctes, False)
        items = self.items(q, rel.attrs)
        if grouped:
            return self.grouped(q, rel, items, ctes)
        low = self.lowering(rel.attrs, ctes)
        return self.finish(q, rel.df, items, rel.attrs, low, prefer_source=True)

    def from_where(self, q: A.Query, ctes: dict[str, Planned], ordered: bool) -> Relation:
        if q.source is None:
            rel = Relation(self.spark.range(1).select(), [], [])
        else:
            rel = self.source(q.source, ctes, ordered)
            for j in q.joins:
                rel = self.join(rel, j, ctes, ordered)
        if q.where is not None:
            rel = Relation(rel.df.where(self.lowering(rel.attrs, ctes).condition(self.resolved(q.where, rel.attrs))), rel.attrs, rel.rows)
        return rel

    def items(self, q: A.Query, attrs: list[Attr]) -> list[tuple[str, A.Expr]]:
        """(output name, resolved expression) of the select list."""
        out = []
        for item in q.items:
            if isinstance(item, A.Star):
                hits = [a for a in attrs if item.qualifier in (None, a.qualifier)]
                if not hits:
                    raise AnalysisError(f"nothing stands for '{item.qualifier or ''}*'")
                out += [(a.name, A.Column(HERE, a.column)) for a in hits]
            else:
                out.append((item.alias or output_name(item.expr), self.resolved(item.expr, attrs)))
        return out

    def grouped(self, q: A.Query, rel: Relation, items: list[tuple[str, A.Expr]], ctes: dict[str, Planned], ordered: bool = False) -> Planned:
        low = self.lowering(rel.attrs, ctes)
        keys = list(dict.fromkeys(self.resolved(e, rel.attrs) for e in q.group_by))
        having = None if q.having is None else self.resolved(q.having, rel.attrs)
        names = [n for n, _ in items]
        orders = []
        for o in q.order_by:
            e = o.expr
            if isinstance(e, A.Column) and e.qualifier is None and names.count(e.name) == 1:
                e = items[names.index(e.name)][1]
            else:
                e = self.resolved(e, rel.attrs)
            orders.append(A.Order(e, o.descending))
        key_cols, key_attrs, types = {}, [], {}
        for k in keys:
            c, t = low.lower(k)
            name = self.fresh("k")
            key_cols[k] = A.Column(HERE, name)
            key_attrs.append(c.alias(name))
            types[name] = t
        aggs: dict[A.Expr, A.Column] = {}
        outputs: list[Column] = []
        bare: dict[str, A.Column] = {}

        def find(e: A.Expr) -> A.Expr | None:
            if e in key_cols:
                return key_cols[e]
            if isinstance(e, A.Aggregate):
                if e.expr is not None and has_aggregate(e.expr):
                    raise AnalysisError("an aggregate inside an aggregate")
                if e not in aggs:
                    c, t = low.aggregate(e)
                    name = self.fresh("a")
                    outputs.append(c.alias(name))
                    types[name] = t
                    aggs[e] = A.Column(HERE, name)
                return aggs[e]
            if isinstance(e, A.Column):
                if e.name not in bare:  # the value in the first row of the group
                    name = self.fresh("b")
                    bare[e.name] = A.Column(HERE, name)
                    types[name] = low.types[e.name]
                    if ordered:
                        outputs.append(F.min_by(F.struct(F.col(e.name).alias("v")), F.struct(*rel.rows)).getField("v").alias(name))
                return bare[e.name]
            return None

        new_items = [(n, A.replace_top(e, find)) for n, e in items]
        new_having = None if having is None else A.replace_top(having, find)
        new_orders = tuple(A.Order(A.replace_top(o.expr, find), o.descending) for o in orders)
        if bare and not ordered:
            again = self.from_where(q, ctes, True)
            return self.grouped(q, again, self.items(q, again.attrs), ctes, True)
        if not outputs:
            df = rel.df.select(*key_attrs).distinct()
        else:
            df = rel.df.groupBy(*key_attrs).agg(*outputs) if key_attrs else rel.df.agg(*outputs)
        after = Lowering(self, types, ctes)
        if new_having is not None:
            df = df.where(after.condition(new_having))
        rest = A.Query(items=q.items, order_by=new_orders, limit=q.limit, distinct=q.distinct)
        return self.finish(rest, df, new_items, [], after, prefer_source=False)

    def finish(self, q: A.Query, df: DataFrame, items: list[tuple[str, A.Expr]], attrs: list[Attr], low: Lowering, prefer_source: bool) -> Planned:
        """Select list, DISTINCT, ORDER BY and LIMIT."""
        lowered = [low.lower(e) for _, e in items]
        columns = [self.fresh("o") for _ in items]
        names, types = [n for n, _ in items], [t for _, t in lowered]
        out = [c.alias(n) for (c, _), n in zip(lowered, columns, strict=True)]
        keys = []
        if q.order_by:
            if not prefer_source or all(self.resolves(o.expr, attrs) for o in q.order_by):
                keys = [low.lower(self.resolved(o.expr, attrs))[0] for o in q.order_by]
            else:  # by output names
                subst = [Attr(None, n, f"\0{i}", t) for i, (n, t) in enumerate(zip(names, types, strict=True))]
                for o in q.order_by:
                    places = self.resolved(o.expr, [*subst] if self.resolves(o.expr, subst) else [*subst, *attrs])
                    back = A.rewrite(places, lambda e: items[int(e.name[1:])][1] if isinstance(e, A.Column) and e.name[:1] == "\0" else e, False)
                    keys.append(low.lower(back)[0])
        hidden = [self.fresh("s") for _ in keys]
        directions = [o.descending for o in q.order_by]
        df = df.select(*out, *[k.alias(h) for k, h in zip(keys, hidden, strict=True)])
        if q.distinct:
            if not hidden:
                df = df.distinct()
            elif len(set(directions)) == 1:  # the first of equal rows in sort order
                best = (F.max if directions[0] else F.min)(F.struct(*hidden)).alias("__best")
                df = df.groupBy(*columns).agg(best).select(*columns, "__best.*")
            else:
                by = Window.partitionBy(*columns).orderBy(*self.sorting(hidden, directions))
                df = df.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
        if hidden:
            df = df.orderBy(*self.sorting(hidden, directions))
        if q.limit is not None:
            df = df.limit(q.limit)
        return Planned(df.select(*columns) if hidden else df, columns, names, types)

    def sorting(self, hidden: list[str], directions: list[bool]) -> list[Column]:
        return [F.col(h).desc_nulls_last() if d else F.col(h).asc_nulls_first() for h, d in zip(hidden, directions, strict=True)]


class Lowering:
    """Expressions with resolved columns to Spark columns."""

    def __init__(self, planner: Planner, types: dict[str, str], ctes: dict[str, Planned], incoming: dict[str, tuple[Column, str]] | None = None):
        self.planner, self.types, self.ctes, self.incoming = planner, types, ctes, incoming or {}

    def condition(self, e: A.Expr) -> Column:
        return self.truth(*self.lower(e))

    def truth(self, c: Column, t: str) -> Column:
        """A value as truth: zero and the empty text are false."""
        if t == "bool":
            return c
        if t in K.NUMERIC:
            return c != F.lit(0)
        if t == "text":
            return c != F.lit("")
        return F.lit(None).cast("boolean") if t == "null" else c.isNotNull()

    def number(self, e: A.Expr) -> tuple[Column, str]:
        c, t = self.lower(e)
        if t == "null":
            return F.lit(None).cast("bigint"), "int"
        if t not in K.NUMERIC:
            raise AnalysisError("Arithmetic requires numeric values")
        return (c.cast("bigint"), t) if t == "int" else (c.cast("double"), t)

    def lower(self, e: A.Expr) -> tuple[Column, str]:
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def _column(self, e: A.Column) -> tuple[Column, str]:
        if e.qualifier != HERE:
            raise AnalysisError(f"Unknown column '{e.name}'")
        return F.col(e.name), self.types[e.name]

    def _literal(self, e: A.Literal) -> tuple[Column, str]:
        return F.lit(e.value).cast(K.SPARK[e.type]), e.type

    def _param(self, e: A.Param) -> tuple[Column, str]:
        raise AnalysisError(f"parameter {e.index + 1} is not bound")

    def _incoming(self, e: A.Incoming) -> tuple[Column, str]:
        if e.name not in self.incoming:
            raise AnalysisError(f"VALUES({e.name}) stands only in ON DUPLICATE KEY UPDATE")
        return self.incoming[e.name]

    def _aggregate(self, e: A.Aggregate) -> tuple[Column, str]:
        raise AnalysisError("an aggregate cannot stand here")

    def _binary(self, e: A.Binary) -> tuple[Column, str]:
        if e.op in ("AND", "OR"):
            a, b = self.condition(e.left), self.condition(e.right)
            return (a & b if e.op == "AND" else a | b), "bool"
        if e.op in "+-*/":
            (a, ta), (b, tb) = self.number(e.left), self.number(e.right)
            t = "int" if ta == tb == "int" else "float"
            if e.op == "/":
                return (F.call_function("div", a, b) if t == "int" else a / b), t
            return {"+": a + b, "-": a - b, "*": a * b}[e.op], t
        return self.compare(e.op, *self.lower(e.left), *self.lower(e.right)), "bool"

    def compare(self, op: str, a: Column, ta: str, b: Column, tb: str) -> Column:
        if "null" in (ta, tb):
            return F.lit(None).cast("boolean")
        if not K.comparable(ta, tb):
            if "text" in (ta, tb) and not {ta, tb} & {"int", "float", "bool"}:  # a date or the like against its text
                a, b = (a, b.cast(ta)) if tb == "text" else (a.cast(tb), b)
            else:  # unlike types: never equal, never ordered, always different
                return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.lit(op == "!="))
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def _unary(self, e: A.Unary) -> tuple[Column, str]:
        if e.op == "NOT":
            return ~self.condition(e.expr), "bool"
        if isinstance(e.expr, A.Literal) and e.expr.type in K.NUMERIC:
            return self._literal(A.Literal(-e.expr.value if e.op == "-" else e.expr.value, e.expr.type))
        c, t = self.number(e.expr)
        return (-c if e.op == "-" else c), t

    def _isnull(self, e: A.IsNull) -> tuple[Column, str]:
        c, _ = self.lower(e.expr)
        return (c.isNotNull() if e.negated else c.isNull()), "bool"

    def _like(self, e: A.Like) -> tuple[Column, str]:
        (a, ta), (p, tp) = self.lower(e.expr), self.lower(e.pattern)
        if "null" in (ta, tp):
            return F.lit(None).cast("boolean"), "bool"
        if (ta, tp) != ("text", "text"):
            c = F.when(a.isNull() | p.isNull(), F.lit(None)).otherwise(F.lit(False))
        elif isinstance(e.pattern, A.Literal):  # a backslash is no escape
            c = a.ilike(e.pattern.value.replace("\\", "\\\\"))
        else:
            c = F.ilike(a, F.replace(p, F.lit("\\"), F.lit("\\\\")))
        return (~c if e.negated else c), "bool"

    def _inlist(self, e: A.InList) -> tuple[Column, str]:
        a, ta = self.lower(e.expr)
        items = [self.lower(x) for x in e.items]
        kinds = {t for _, t in items if t != "null"}
        if ta != "null" and all(K.comparable(ta, t) for t in kinds) and all(isinstance(x, (A.Literal, A.Unary)) for x in e.items):
            c = a.isin(*[c if t != "null" else F.lit(None) for c, t in items])
        else:
            c = reduce(lambda x, y: x | y, [self.compare("=", a, ta, b, tb) for b, tb in items])
        return (~c if e.negated else c), "bool"

    def _inquery(self, e: A.InQuery) -> tuple[Column, str]:
        a, ta = self.lower(e.expr)
        p = self.planner.query(e.query, self.ctes)
        if len(p.columns) != 1:
            raise AnalysisError("a subquery in IN needs one column")
        if not K.comparable(ta, p.types[0]):
            raise AnalysisError(f"IN compares {ta} with {p.types[0]}")
        if ta in K.NUMERIC and p.types[0] in K.NUMERIC and ta != p.types[0]:
            a, sub = a.cast("double"), p.df.select(F.col(p.columns[0]).cast("double"))
        else:
            sub = p.df.select(p.columns[0])
        c = a.isin(sub)
        return (~c if e.negated else c), "bool"

    def _exists(self, e: A.Exists) -> tuple[Column, str]:
        c = self.planner.query(e.query, self.ctes).df.exists()
        return (~c if e.negated else c), "bool"

    def _scalar(self, e: A.Scalar) -> tuple[Column, str]:
        p = self.planner.query(e.query, self.ctes)
        if len(p.columns) != 1:
            raise AnalysisError("a scalar subquery needs one column")
        return p.df.select(p.columns[0]).scalar(), p.types[0]

    def aggregate(self, e: A.Aggregate) -> tuple[Column, str]:
        if e.expr is None:
            return F.count(F.lit(1)), "int"
        c, t = self.lower(e.expr)
        if e.function == "count":
            return (F.count_distinct(c) if e.distinct else F.count(c)), "int"
        if e.function in ("min", "max"):
            return (F.min(c) if e.function == "min" else F.max(c)), t
        if t == "null":
            return F.lit(None).cast("bigint"), "int"
        if t not in K.NUMERIC:
            raise AnalysisError(f"{e.function.upper()} requires numeric values")
        if e.function == "sum":
            return (F.sum_distinct(c) if e.distinct else F.sum(c)), t
        return _avg(c, e.distinct), "float"


def _avg(c: Column, distinct: bool) -> Column:
    return F.try_divide(F.sum_distinct(c).cast("double"), F.count_distinct(c)) if distinct else F.avg(c)
