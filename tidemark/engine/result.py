"""What a statement gives back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Result:
    """``kind`` is select, rows, table_created, table_dropped, index_created, index_dropped, altered, tables, indexes,
    describe, explain, begin, commit, rollback or done."""

    kind: str
    count: int = 0
    name: str = ""
    frame: DataFrame | None = None
    lines: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    values: list[tuple] = field(default_factory=list)

    def rows(self) -> list[tuple]:
        """The rows of a query, brought to the driver."""
        return [tuple(r) for r in self.frame.collect()] if self.frame is not None else self.values

    def stream(self) -> Iterator[tuple]:
        """The rows of a query one after another: the driver holds a partition of the result at a time."""
        return (tuple(r) for r in self.frame.toLocalIterator(True)) if self.frame is not None else iter(self.values)

    def text(self) -> str:
        messages = {
            "rows": f"{self.count} row(s) affected",
            "table_created": f"Table '{self.name}' created",
            "table_dropped": f"Table '{self.name}' dropped",
            "index_created": f"Index '{self.name}' created",
            "index_dropped": f"Index '{self.name}' dropped",
            "altered": f"Table '{self.name}' altered",
            "begin": "Transaction started",
            "commit": "Transaction committed",
            "rollback": "Transaction rolled back",
            "done": "OK",
        }
        if self.kind in messages:
            return messages[self.kind]
        if self.kind == "tables":
            return "\n".join(self.lines) or "No tables"
        if self.kind in ("indexes", "explain"):
            return "\n".join(self.lines)
        columns = self.frame.columns if self.frame is not None else self.columns
        return grid(columns, self.rows())


def shown(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return str(v)


def grid(columns: list[str], rows: list[tuple]) -> str:
    """Rows as a table of characters."""
    if not columns:
        return "Empty result set"
    cells = [[shown(v) for v in r] for r in rows]
    widths = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r: "|" + "|".join(f" {v:<{w}} " for v, w in zip(r, widths, strict=True)) + "|"
    return "\n".join([rule, line(columns), rule, *map(line, cells), rule, f"{len(rows)} row(s)"])
