"""Statements that change tables, on a private copy of a manifest."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.engine import ast as A
from tidemark.engine import constraints as C
from tidemark.engine import dml
from tidemark.engine import types as K
from tidemark.engine.catalog import RID, Col, Index, Manifest, Rule, Store, Table, check_expr
from tidemark.engine.errors import AnalysisError, ConstraintError, SqlError, Unsupported
from tidemark.engine.evaluate import evaluate, truth
from tidemark.engine.planner import Planner, Source
from tidemark.session import cut, local_frame

#: An upsert into a table with several unique keys, or one that changes its key, couples any row with any other, so it is
#: folded in row order on the driver: up to so many rows. With one key that stays there is no limit.
FOLD_ROWS = 100_000


class Workspace:
    """A manifest being changed. Files are written at once; nothing refers to them until the manifest is published."""

    def __init__(self, store: Store, manifest: Manifest):
        self.store, self.m, self.spark = store, manifest.copy(), store.spark
        self.base = manifest.version
        self.written: list[str] = []
        self.schema_changed = False
        self.changed = False
        self.first_new = 0

    def planner(self) -> Planner:
        return Planner(self.spark, self.lookup)

    def lookup(self, name: str) -> Source | None:
        t = self.m.tables.get(name)
        return None if t is None else Source(self.store.frame(t), [RID], (RID,))

    def table(self, name: str) -> Table:
        if name not in self.m.tables:
            raise AnalysisError(f"Table '{name}' does not exist")
        return self.m.tables[name]

    def discard(self) -> None:
        self.store.discard(self.written)

    def save(self, t: Table, df: DataFrame) -> list[str]:
        files = self.store.write(t, df)
        self.written += files
        return files

    # -- definitions
    def create_table(self, s: A.CreateTable) -> bool:
        if s.table in self.m.tables:
            if s.if_not_exists:
                return False
            raise SqlError(f"Table '{s.table}' already exists")
        t = Table(s.table, [])
        for c in s.columns:
            if t.column(c.name):
                raise AnalysisError(f"Duplicate column '{c.name}'")
            self.new_column(t, c)
        if not t.columns:
            raise AnalysisError("a table needs a column")
        self.m.tables[s.table] = t
        try:
            for c in [*(x for d in s.columns for x in d.inline), *s.constraints]:
                self.add_rule(t, c, fresh=True)
        except SqlError:
            del self.m.tables[s.table]
            raise
        self.schema_changed = self.changed = True
        return True

    def new_column(self, t: Table, c: A.ColumnDef) -> Col:
        default = None
        if c.default is not None:
            default = self.coerced(c.default, c.type, c.name)
        col = Col(c.name, c.type, f"c{t.next_column}", c.nullable, default)
        t.next_column += 1
        t.columns.append(col)
        return col

    def coerced(self, v: A.Literal, kind: str, name: str) -> list:
        if not K.coercible(v.type, kind):
            raise AnalysisError(f"Type mismatch for the default of column '{name}'")
        return [float(v.value) if kind == "float" and v.type == "int" else v.value, kind if v.type != "null" else "null"]

    def add_rule(self, t: Table, c: A.Constraint, fresh: bool = False) -> None:
        """Add a constraint and its automatic index; unless the table is new, its rows must satisfy it."""
        for name in c.columns:
            if not t.column(name):
                raise AnalysisError(f"Unknown column '{name}' in a constraint")
        generated = {
            "primary": f"{t.name}_pk",
            "unique": f"{t.name}_{'_'.join(c.columns)}_uk",
            "foreign": f"{t.name}_{'_'.join(c.columns)}_fk",
            "check": f"{t.name}_check",
        }[c.kind]
        rule = Rule(c.kind, c.name or generated, list(c.columns), None, c.ref_table, list(c.ref_columns), bool(c.name))
        if c.name and any(r.name == c.name for r in t.rules):
            raise SqlError(f"Constraint '{c.name}' already exists")
        if c.kind == "primary":
            if any(r.kind == "primary" for r in t.rules):
                raise SqlError("a table has one primary key")
            for name in c.columns:
                t.column(name).nullable = False
        if c.kind == "check":
            for e in A.walk(c.check):
                if isinstance(e, A.Column) and not t.column(e.name):
                    raise AnalysisError(f"Unknown column '{e.name}' in CHECK")
                if isinstance(e, (A.Scalar, A.Exists, A.InQuery, A.Aggregate)):
                    raise Unsupported("CHECK takes neither subqueries nor aggregates")
            rule.check = A.to_json(A.rewrite(c.check, lambda e: A.Column(None, e.name) if isinstance(e, A.Column) else e))
        if c.kind == "foreign":
            parent = self.table(c.ref_table)
            if [r for r in parent.rules if r.kind in ("primary", "unique") and r.columns == rule.ref_columns] == []:
                raise SqlError("a foreign key refers to exactly the columns of a primary or unique key")
            if len(rule.ref_columns) != len(rule.columns):
                raise SqlError("a foreign key has as many columns as the key it refers to")
        t.rules.append(rule)
        if c.kind != "check":
            t.indexes.append(Index(rule.name, list(c.columns), c.kind != "foreign", True))
        if not fresh:
            self.validate(t, [rule])
            if c.kind == "primary":
                C.require_none(C.nulls(self.store.frame(t), c.columns), "a primary key cannot be NULL")

    def inbound(self, name: str) -> list[tuple[Table, Rule]]:
        return [(t, r) for t in self.m.tables.values() for r in t.rules if r.kind == "foreign" and r.ref_table == name]

    def drop_table(self, s: A.DropTable) -> bool:
        if s.table not in self.m.tables:
            if s.if_exists:
                return False
            raise AnalysisError(f"Table '{s.table}' does not exist")
        if any(t.name != s.table for t, _ in self.inbound(s.table)):
            raise ConstraintError(f"Table '{s.table}' is referenced by a foreign key")
        del self.m.tables[s.table]
        self.schema_changed = self.changed = True
        return True

    def create_index(self, s: A.CreateIndex) -> bool:
        t = self.table(s.table)
        if any(i.name == s.name for i in t.indexes):
            if s.if_not_exists:
                return False
            raise SqlError(f"Index '{s.name}' already exists")
        for c in s.columns:
            if not t.column(c):
                raise AnalysisError(f"Unknown column '{c}'")
        if s.unique:
            C.require_none(C.repeated_keys(self.store.frame(t), s.columns), f"Duplicate values for unique index '{s.name}'")
        t.indexes.append(Index(s.name, s.columns, s.unique))
        self.schema_changed = self.changed = True
        return True

    def drop_index(self, s: A.DropIndex) -> bool:
        t = self.table(s.table)
        found = next((i for i in t.indexes if i.name == s.name), None)
        if found is None:
            if s.if_exists:
                return False
            raise AnalysisError(f"Index '{s.name}' does not exist")
        if found.automatic:
            raise SqlError(f"Index '{s.name}' belongs to a constraint")
        t.indexes.remove(found)
        self.schema_changed = self.changed = True
        return True

    def alter(self, s: A.AlterTable) -> None:
        """All operations or none: they work on a copy of the tables."""
        before = self.m.copy()
        try:
            for op, *args in s.operations:
                getattr(self, "_" + op)(self.table(s.table), *args)
        except BaseException:
            self.m = before
            raise
        self.schema_changed = self.changed = True

    def rewrite(self, t: Table, change: Callable[[DataFrame], DataFrame]) -> None:
        """New files for the whole table; a change that leaves the rows alone keeps the old ones."""
        if t.files:
            t.files = self.save(t, change(self.store.frame(t)))

    def _add_column(self, t: Table, c: A.ColumnDef, if_not_exists: bool) -> None:
        if t.column(c.name):
            if if_not_exists:
                return
            raise AnalysisError(f"Duplicate column '{c.name}'")
        if not c.nullable and c.default is None and t.files and self.store.frame(t).limit(1).count():
            raise ConstraintError(f"Column '{c.name}' is NOT NULL and needs a default")
        old = self.store.frame(t) if t.files else None
        col = self.new_column(t, c)
        if old is not None and col.default is not None:
            t.files = self.save(t, old.withColumn(col.name, F.lit(col.default[0]).cast(K.SPARK[col.type])))
        for rule in c.inline:
            self.add_rule(t, rule)

    def _drop_column(self, t: Table, name: str, if_exists: bool) -> None:
        c = t.column(name)
        if c is None:
            if if_exists:
                return
            raise AnalysisError(f"Unknown column '{name}'")
        if len(t.columns) == 1:
            raise SqlError("the last column cannot be dropped")
        used = any(name in r.columns or (r.check and any(isinstance(e, A.Column) and e.name == name for e in A.walk(check_expr(r)))) for r in t.rules)
        if used or any(name in i.columns for i in t.indexes) or any(name in r.ref_columns for _, r in self.inbound(t.name)):
            raise ConstraintError(f"Column '{name}' is in use")
        t.columns.remove(c)

    def _rename_column(self, t: Table, old: str, new: str) -> None:
        c = t.column(old)
        if c is None:
            raise AnalysisError(f"Unknown column '{old}'")
        if new != old and t.column(new):
            raise AnalysisError(f"Duplicate column '{new}'")
        c.name = new
        swap = lambda names: [new if n == old else n for n in names]
        for r in t.rules:
            r.columns = swap(r.columns)
            if r.check:
                r.check = A.to_json(A.rewrite(check_expr(r), lambda e: A.Column(None, new) if isinstance(e, A.Column) and e.name == old else e))
        for i in t.indexes:
            i.columns = swap(i.columns)
        for _, r in self.inbound(t.name):
            r.ref_columns = swap(r.ref_columns)

    def _set_type(self, t: Table, name: str, kind: str) -> None:
        c = t.column(name)
        if c is None:
            raise AnalysisError(f"Unknown column '{name}'")
        if c.type == kind:
            return
        frame = self.store.frame(t)
        if not K.coercible(c.type, kind):
            C.require_none(frame.where(F.col(name).isNotNull()), f"Column '{name}' cannot become {K.SHOWN[kind]} without loss")
        if c.default is not None:
            c.default = self.coerced(A.Literal(*c.default), kind, name)
        cast = K.SPARK[kind]
        changed = frame.withColumn(name, F.col(name).cast(cast) if K.coercible(c.type, kind) else F.lit(None).cast(cast))
        c.type = kind
        c.physical, t.next_column = f"c{t.next_column}", t.next_column + 1
        if t.files:
            t.files = self.save(t, changed)

    def _change_column(self, t: Table, old: str, d: A.ColumnDef) -> None:
        if d.name != old:
            self._rename_column(t, old, d.name)
        self._set_type(t, d.name, d.type)
        c = t.column(d.name)
        if d.default is not None:
            c.default = self.coerced(d.default, d.type, d.name)
        if not d.nullable and c.nullable:
            self._set_nullable(t, d.name, False)
        elif d.nullable and not c.nullable and not any(r.kind == "primary" and d.name in r.columns for r in t.rules):
            c.nullable = True
        for rule in d.inline:
            if rule.kind in ("primary", "unique") and any(r.kind == rule.kind and r.columns == rule.columns for r in t.rules):
                continue
            self.add_rule(t, rule)

    def _set_default(self, t: Table, name: str, value: A.Literal | None) -> None:
        c = t.column(name)
        if c is None:
            raise AnalysisError(f"Unknown column '{name}'")
        c.default = None if value is None else self.coerced(value, c.type, name)

    def _set_nullable(self, t: Table, name: str, nullable: bool) -> None:
        c = t.column(name)
        if c is None:
            raise AnalysisError(f"Unknown column '{name}'")
        if nullable and any(r.kind == "primary" and name in r.columns for r in t.rules):
            raise ConstraintError("a primary key cannot become nullable")
        if not nullable:
            C.require_none(C.nulls(self.store.frame(t), [name]), f"Column '{name}' contains NULL")
        c.nullable = nullable

    def _add_constraint(self, t: Table, c: A.Constraint) -> None:
        self.add_rule(t, c)

    def _drop_constraint(self, t: Table, name: str | None, if_exists: bool, kind: str | None) -> None:
        def fits(r: Rule) -> bool:
            if kind == "primary":
                return r.kind == "primary"
            wanted = {"foreign": ("foreign",), "check": ("check",), "index": ("unique", "primary", "foreign")}.get(kind, ("primary", "unique", "check", "foreign"))
            return r.name == name and r.kind in wanted

        rule = next((r for r in t.rules if fits(r)), None)
        if rule is None:
            index = next((i for i in t.indexes if kind == "index" and i.name == name and not i.automatic), None)
            if index:
                t.indexes.remove(index)
                return
            if if_exists:
                return
            raise AnalysisError(f"Constraint '{name or 'PRIMARY KEY'}' does not exist")
        if rule.kind in ("primary", "unique") and any(r.ref_columns == rule.columns for _, r in self.inbound(t.name)):
            raise ConstraintError(f"Constraint '{rule.name}' is referenced by a foreign key")
        t.rules.remove(rule)
        t.indexes = [i for i in t.indexes if not (i.automatic and i.name == rule.name)]

    # -- constraints
    def validate(self, t: Table, rules: list[Rule], rows: DataFrame | None = None, into: C.Checks | None = None, keys_only: bool = False, same_keys: bool = False) -> None:
        """Whether the table satisfies ``rules``. With ``rows``, the only new ones, just these are looked at: their
        keys are joined with the table's, which was valid before. ``keys_only`` leaves out what the rows show by
        themselves, ``same_keys`` the unique keys, which no row changed."""
        checks = into or C.Checks()
        frame = self.store.frame(t)
        looked = frame if rows is None else rows
        for r in rules:
            if r.kind in ("primary", "unique"):
                if same_keys:
                    continue
                self.unique(t, r.columns, r.name, frame, rows, checks, keys_only)
            elif r.kind == "check" and not keys_only:
                checks.none(C.failed_check(self.spark, looked.drop(RID), check_expr(r)), f"CHECK constraint '{r.name}' failed")
            elif r.kind == "foreign":
                parent = self.store.frame(self.table(r.ref_table))
                checks.none(C.missing_parents(looked, r.columns, parent, r.ref_columns), f"FOREIGN KEY constraint '{r.name}' failed")
        if into is None:
            checks.run()

    def unique(self, t: Table, columns: list[str], name: str, frame: DataFrame, rows: DataFrame | None, checks: C.Checks, keys_only: bool = False) -> None:
        message = f"Duplicate value for unique key '{name}' of table '{t.name}'"
        if not keys_only:
            checks.none(C.repeated_keys(frame if rows is None else rows, columns), message)
        if rows is not None:
            there = frame.where(F.col(RID) < self.first_new)
            checks.none(rows.select(*columns).join(there.select(*columns), columns, "left_semi"), message)

    def validate_rows(self, t: Table, rows: DataFrame | None, keys_only: bool = False, same_keys: bool = False) -> None:
        """Everything that a write to ``t`` can break: its own constraints (on ``rows`` if these are all that is new)."""
        checks = C.Checks()
        needed = [c.name for c in t.columns if not c.nullable]
        looked = self.store.frame(t) if rows is None else rows
        if needed and not keys_only:
            checks.none(C.nulls(looked, needed), f"NOT NULL constraint failed on table '{t.name}'")
        self.validate(t, t.rules, rows, checks, keys_only, same_keys)
        for i in t.indexes:
            if i.unique and not i.automatic and not same_keys:
                self.unique(t, i.columns, i.name, self.store.frame(t), rows, checks, keys_only)
        checks.run()

    def validate_constants(self, t: Table, rows: list[tuple]) -> None:
        """What constant rows break by themselves, without a job."""
        names = [c.name for c in t.columns]
        dicts = [dict(zip(names, r, strict=True)) for r in rows]
        for c in t.columns:
            if not c.nullable and any(d[c.name] is None for d in dicts):
                raise ConstraintError(f"NOT NULL constraint failed on table '{t.name}'")
        for r in t.rules:
            if r.kind == "check" and any(truth(evaluate(check_expr(r), d)) is False for d in dicts):
                raise ConstraintError(f"CHECK constraint '{r.name}' failed")
        for key in t.unique_keys():
            whole = [k for d in dicts if None not in (k := tuple(d[c] for c in key))]
            if len(whole) != len(set(whole)):
                raise ConstraintError(f"Duplicate value for unique key ({', '.join(key)}) of table '{t.name}'")

    def validate_inbound(self, t: Table, changed: set[str] | None = None) -> None:
        """References to ``t`` after rows of it went, or the columns ``changed`` did."""
        checks = C.Checks()
        for child, r in self.inbound(t.name):
            if changed is not None and not changed & set(r.ref_columns):
                continue
            checks.none(
                C.missing_parents(self.store.frame(child), r.columns, self.store.frame(t), r.ref_columns),
                f"FOREIGN KEY constraint '{r.name}' of table '{child.name}' failed",
            )
        checks.run()

    # -- writes
    def statement_atomic(self, t: Table, write: Callable[[], int]) -> int:
        before = self.m.copy()
        try:
            n = write()
        except BaseException:
            self.m = before
            raise
        self.changed = self.changed or n > 0
        return n

    def insert(self, s: A.Insert) -> int:
        t = self.table(s.table)
        names = s.columns if s.columns is not None else [c.name for c in t.columns]
        for i, n in enumerate(names):
            if not t.column(n):
                raise AnalysisError(f"Unknown column '{n}'")
            if n in names[:i]:
                raise AnalysisError(f"Duplicate column '{n}'")
        rows = self.value_rows(t, names, s.rows) if s.rows is not None else self.query_rows(t, names, s.query)
        return self.statement_atomic(t, lambda: self.upsert(t, rows, s) if s.on_duplicate else self.append(t, rows))

    def value_rows(self, t: Table, names: list[str], rows: list[list[A.Expr]]) -> list[tuple]:
        """Constant rows in column order; an omitted column has its default."""
        out = []
        for row in rows:
            if len(row) != len(names):
                raise AnalysisError(f"INSERT has {len(row)} values for {len(names)} columns")
            given = {}
            for n, e in zip(names, row, strict=True):
                v, c = evaluate(e), t.column(n)
                kind = K.value_type(v)
                if not K.coercible(kind, c.type):
                    raise AnalysisError(f"Type mismatch for column '{n}': {kind} is no {c.type}")
                given[n] = float(v) if c.type == "float" and v is not None else v
            out.append(tuple(given[c.name] if c.name in given else (c.default[0] if c.default else None) for c in t.columns))
        return out

    def query_rows(self, t: Table, names: list[str], q: A.Query) -> DataFrame:
        p = self.planner().query(q)
        if len(p.columns) != len(names):
            raise AnalysisError(f"INSERT has {len(p.columns)} values for {len(names)} columns")
        given = {}
        for n, c, kind in zip(names, p.columns, p.types, strict=True):
            if not K.coercible(kind, t.column(n).type):
                raise AnalysisError(f"Type mismatch for column '{n}': {kind} is no {t.column(n).type}")
            given[n] = F.col(c)
        value = lambda c: given[c.name] if c.name in given else F.lit(c.default[0] if c.default else None)
        return p.df.select(*[value(c).cast(K.SPARK[c.type]).alias(c.name) for c in t.columns])

    def append(self, t: Table, rows: list[tuple] | DataFrame) -> int:
        """Add rows as new files and look only at them and their keys."""
        if isinstance(rows, list):
            if not rows:
                return 0
            self.validate_constants(t, rows)
            n, self.first_new = len(rows), t.next_rid
            numbered = [(*r, t.next_rid + i) for i, r in enumerate(rows)]
            df = local_frame(self.spark, numbered, t.schema()).coalesce(1)
            t.next_rid += n
            files = self.save(t, df)
        else:
            self.first_new = t.next_rid
            files = self.save(t, rows.withColumn(RID, F.monotonically_increasing_id() + F.lit(t.next_rid)))
            probe = Table(t.name, t.columns, files=files)
            n, last = self.store.frame(probe).agg(F.count(F.lit(1)), F.max(RID)).first()
            if not n:
                return 0
            t.next_rid = last + 1
        t.files = [*t.files, *files]
        self.validate_rows(t, self.store.frame(Table(t.name, t.columns, files=files)), isinstance(rows, list))
        return n

    def rewritten(self, t: Table, where: A.Expr | None, change: Callable[[DataFrame], DataFrame]) -> tuple[int, DataFrame | None]:
        """Copy-on-write of the files that hold a row which ``where`` meets; the other files stay as they are. The number of
        rows met, and the rows of the new files."""
        if not t.files:
            return 0, None
        planner = self.planner()
        frame = self.store.frame_with_file(t)
        hit = dml.met(planner, frame, t.name, (RID, "__file"), where)
        touched = self.store.affected_files(t, frame.where(hit))
        if not touched:
            return 0, None
        old = self.store.frame_with_file(t, touched)
        n = old.where(dml.met(planner, old, t.name, (RID, "__file"), where)).count()
        new = self.save(t, change(old.drop("__file")))
        t.files = [f for f in t.files if f not in touched] + new
        return n, self.store.frame(Table(t.name, t.columns, files=new))

    def update(self, s: A.Update) -> int:
        t = self.table(s.table)
        for name, _ in s.assignments:
            if not t.column(name):
                raise AnalysisError(f"Unknown column '{name}'")

        def write() -> int:
            n, new = self.rewritten(t, s.where, lambda df: dml.updated(self.planner(), df, s, (RID,)))
            if n:
                changed = {name for name, _ in s.assignments}
                kept = not any(changed & set(key) for key in t.unique_keys())
                self.validate_rows(t, new if kept else None, same_keys=kept)
                self.validate_inbound(t, changed)
            return n

        return self.statement_atomic(t, write)

    def delete(self, s: A.Delete) -> int:
        t = self.table(s.table)

        def write() -> int:
            n, _ = self.rewritten(t, s.where, lambda df: dml.deleted(self.planner(), df, s, (RID,)))
            if n:
                self.validate_inbound(t)
            return n

        return self.statement_atomic(t, write)

    def upsert(self, t: Table, rows: list[tuple] | DataFrame, s: A.Insert) -> int:
        for name, e in s.on_duplicate:
            if not t.column(name):
                raise AnalysisError(f"Unknown column '{name}'")
            for x in A.walk(e):
                if isinstance(x, A.Incoming) and not t.column(x.name):
                    raise AnalysisError(f"Unknown column '{x.name}'")
        keys = t.unique_keys()
        if not keys:
            return self.append(t, rows)
        schema = t.schema()
        if isinstance(rows, list):
            if not rows:
                return 0
            df = local_frame(self.spark, [(*r, None) for r in rows], schema)
        else:
            df = rows.withColumn(RID, F.lit(None).cast("long"))
        set_names = {n for n, _ in s.on_duplicate}
        plain = not any(isinstance(x, (A.Scalar, A.Exists, A.InQuery)) for _, e in s.on_duplicate for x in A.walk(e))
        joined = len(keys) == 1 and not set_names & set(keys[0])
        if joined and not C.repeated_keys(df, keys[0]).limit(1).count():
            return self.joined_upsert(t, df, keys[0], s)
        if not plain:
            raise Unsupported("a subquery in the assignments of an upsert with conflicting keys")
        if joined:
            return self.upsert_in_order(t, df, keys[0], s)
        batch = [tuple(r)[:-1] for r in df.limit(FOLD_ROWS + 1).collect()] if not isinstance(rows, list) else rows
        if len(batch) > FOLD_ROWS:
            raise Unsupported(f"an upsert of more than {FOLD_ROWS} rows into a table with several unique keys, or that changes the key")
        return self.folded_upsert(t, batch, keys, s)

    def joined_upsert(self, t: Table, rows: DataFrame, key: list[str], s: A.Insert) -> int:
        """Distinct incoming keys: one join decides which rows change. Only the files of those rows are rewritten."""
        columns = [c.name for c in t.columns]
        met = rows.select(*[F.col(k).alias(f"__k_{k}") for k in key])
        on: Column = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__k_{k}") for k in key])
        touched = self.store.affected_files(t, self.store.frame_with_file(t).join(met, on, "left_semi")) if t.files else []
        changed = 0
        fresh = rows
        if touched:
            old = self.store.frame_with_file(t, touched).drop("__file")
            there = rows.join(old.select(*key), key, "left_semi")
            fresh = rows.join(old.select(*key), key, "left_anti").select(*rows.columns)
            new = dml.upserted(self.planner(), old, there, key, s.on_duplicate, t.name, (RID,))
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in columns])
            before = old.select(*[F.col(c).alias(f"__o_{c}") for c in columns], F.col(RID).alias("__o"))
            files = self.save(t, new)
            written = self.store.frame(Table(t.name, t.columns, files=files))
            changed = 2 * written.join(before, F.col(RID) == F.col("__o")).where(~same).count()
            t.files = [f for f in t.files if f not in touched] + files
            self.validate_rows(t, written, same_keys=True)
            self.validate_inbound(t, {n for n, _ in s.on_duplicate})
        return changed + self.append(t, fresh.drop(RID))

    def upsert_in_order(self, t: Table, rows: DataFrame, key: list[str], s: A.Insert) -> int:
        """Incoming keys that repeat: the rows of a key, that of the table first, are folded in the order of the batch. The
        executors sort them by key and order and hold one row at a time, so no key is too large."""
        names = [c.name for c in t.columns]
        batch = rows.select(*names).withColumn("__seq", F.monotonically_increasing_id())
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
        met = batch.where(known).select(*key).distinct()
        files = self.store.frame_with_file(t) if t.files else None
        touched = self.store.affected_files(t, files.join(met, key, "left_semi")) if t.files else []
        both = batch.where(known).withColumn(RID, F.lit(None).cast("long"))
        if touched:
            old = self.store.frame_with_file(t, touched).drop("__file")
            both = both.unionByName(old.join(met, key, "left_semi").withColumn("__seq", F.lit(-1).cast("long")))
        arranged = both.repartition(*key).sortWithinPartitions(*key, "__seq").select(*names, RID)
        schema = t.schema().add("__count", T.LongType()).add("__error", T.StringType())
        out = cut(arranged.mapInArrow(dml.fold_in_order({c.name: c.type for c in t.columns}, key, s.on_duplicate, to_arrow_schema(schema)), schema))
        if (failed := out.where(F.col("__error").isNotNull()).select("__error").first()) is not None:
            raise AnalysisError(failed[0])
        count = out.agg(F.sum("__count")).first()[0] or 0
        if touched:
            new = self.save(t, old.join(met, key, "left_anti").select(*names, RID).unionByName(out.where(F.col(RID).isNotNull()).select(*names, RID)))
            t.files = [f for f in t.files if f not in touched] + new
            self.validate_rows(t, self.store.frame(Table(t.name, t.columns, files=new)), same_keys=True)
            self.validate_inbound(t, {n for n, _ in s.on_duplicate})
        fresh = out.where(F.col(RID).isNull()).select(*names)
        self.append(t, fresh.unionByName(batch.where(~known).select(*names)))
        return count + batch.where(~known).count()

    def folded_upsert(self, t: Table, batch: list[tuple], keys: list[list[str]], s: A.Insert) -> int:
        """Rows one after another, as each may meet a row that came before it; bounded by :data:`FOLD_ROWS`."""
        names = [c.name for c in t.columns]
        frame = self.store.frame(t)
        near = None
        for key in keys:
            values = local_frame(self.spark, [tuple(r[names.index(k)] for k in key) for r in batch], self.key_schema(t, key)).distinct()
            part = frame.join(F.broadcast(values), key, "left_semi")
            near = part if near is None else near.unionByName(part)
        old = {r[RID]: {n: r[n] for n in names} for r in near.distinct().collect()}
        rows = {rid: dict(r) for rid, r in old.items()}
        by_key: list[dict[tuple, int]] = [{} for _ in keys]

        def place(rid: int) -> None:
            for key, found in zip(keys, by_key, strict=True):
                k = tuple(rows[rid][c] for c in key)
                if None not in k:
                    found[k] = rid

        for rid in rows:
            place(rid)
        count = 0
        for values in batch:
            incoming = dict(zip(names, values, strict=True))
            hits = {f[k] for key, f in zip(keys, by_key, strict=True) if (k := tuple(incoming[c] for c in key)) in f}
            if len(hits) > 1:
                raise ConstraintError("a row conflicts with several rows")
            if not hits:
                rid, t.next_rid = t.next_rid, t.next_rid + 1
                rows[rid] = incoming
                place(rid)
                count += 1
                continue
            rid = hits.pop()
            new = dict(rows[rid])
            for name, e in s.on_duplicate:
                v, kind = evaluate(e, new, incoming), t.column(name).type
                if not K.coercible(K.value_type(v), kind):
                    raise AnalysisError(f"Type mismatch for column '{name}'")
                new[name] = float(v) if kind == "float" and v is not None else v
            if new != rows[rid]:
                for key, found in zip(keys, by_key, strict=True):
                    k = tuple(rows[rid][c] for c in key)
                    if found.get(k) == rid:
                        del found[k]
                rows[rid] = new
                place(rid)
                count += 2
        gone = [rid for rid, r in old.items() if rows[rid] != r]
        put = [(*[r[n] for n in names], rid) for rid, r in rows.items() if old.get(rid) != r]
        if put:
            if gone:
                ids = local_frame(self.spark, [(g,) for g in gone], T.StructType([T.StructField("__g", T.LongType())]))
                touched = self.store.affected_files(t, self.store.frame_with_file(t).join(F.broadcast(ids), F.col(RID) == F.col("__g"), "left_semi"))
                keep = self.store.frame_with_file(t, touched).drop("__file").join(F.broadcast(ids), F.col(RID) == F.col("__g"), "left_anti")
                t.files = [f for f in t.files if f not in touched] + self.save(t, keep)
            t.files = t.files + self.save(t, local_frame(self.spark, put, t.schema()).coalesce(1))
            self.validate_rows(t, None)
            self.validate_inbound(t)
        return count

    def key_schema(self, t: Table, key: list[str]) -> T.StructType:
        return T.StructType([T.StructField(k, K.SPARK[t.column(k).type]) for k in key])
