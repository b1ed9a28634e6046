"""Loading log lines strictly, and the reasons of those that do not load.

Lines that are spelt just as the log writer spells them are read and checked inside the JVM. These conforming lines are
taken away from all lines by their id, and only the remainder, which is small in a healthy log, goes through the exact
parser that names the first reason for failure or finds an odd but correct spelling sound after all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import walrecord
from tidemark.operators.skew import join_counted
from tidemark.session import cut

_WHOLE = r"(0|[1-9][0-9]{0,17})"
# A text as the writer spells it: no escape that it would not use, no character that it would escape.
_TEXT = r'"[^"\\\x00-\x1f]*+(?:\\["\\nrtbf][^"\\\x00-\x1f]*+)*+"'
_KV = rf'^\{{"format_version":2,"sequence":{_WHOLE},"timestamp_millis":{_WHOLE},"operation":("Clear"|\{{"Set":\{{"key":{_TEXT},"value":{_TEXT}\}}\}}|\{{"Delete":\{{"key":{_TEXT}\}}\}}),"checksum":{_WHOLE}\}}\z'
_SQL = rf'^\{{"format_version":2,"base_version":{_WHOLE},"commit_version":{_WHOLE},"timestamp_millis":{_WHOLE},"statements":(\[(?:\{{"Sql":{_TEXT}\}}(?:,\{{"Sql":{_TEXT}\}})*+)?\]),"checksum":{_WHOLE}\}}\z'
#: Java's regular expressions recurse once an escape or list entry; lines with more of them are left to the exact parser.
_DEPTH = 1000


#: Parts the fields of a conforming line; a text as the writer spells it cannot hold it.
_BAR = "\u0001"


def crc_of(numbers: list[Column], body: Column) -> Column:
    """CRC-32 over the numbers, eight bytes each with the lowest first, and the text. Each argument is used once."""
    highest_first = F.unhex(F.concat(*[F.lpad(F.hex(n), 16, "0") for n in reversed(numbers)]))
    turned = F.encode(F.reverse(F.decode(highest_first, "ISO-8859-1")), "ISO-8859-1")
    return F.crc32(F.concat(turned, F.encode(body, "UTF-8")))


def strict_load(lines: DataFrame) -> DataFrame:
    """The lines that conform to the writer's spelling and whose checksum is right, with their fields: line_id, node_id,
    engine, base_version (sql only), version (sequence or commit_version), timestamp_millis, body.

    One pass: the pattern of the line's engine matches once and hands out all fields.
    """
    shallow = F.length("raw_line") - F.length(F.replace(F.replace("raw_line", F.lit("\\")), F.lit("{"))) < _DEPTH
    fields = lambda pattern, *groups: F.regexp_replace("raw_line", pattern, _BAR + _BAR.join(groups))
    kv, sql = fields(_KV, "", "$1", "$2", "$3", "$4"), fields(_SQL, "$1", "$2", "$3", "$4", "$5")
    hit = F.when(shallow & ~F.col("raw_line").startswith(_BAR), F.when(F.col("engine") == "kv", kv).when(F.col("engine") == "sql", sql))
    # the fields are made into a row, which keeps later conditions from matching the pattern again
    rows = lines.select("line_id", "node_id", "engine", F.explode(F.array(F.split(hit, _BAR))).alias("__f")).where(F.get("__f", F.lit(0)) == "")
    number = lambda i: F.get("__f", F.lit(i)).cast("long")
    of = lambda *numbers: crc_of(list(numbers), F.get("__f", F.lit(4)))
    counted = F.when(F.col("engine") == "kv", of(number(2), number(3))).otherwise(of(number(1), number(2), number(3)))
    base = F.when(F.col("engine") == "sql", number(1)).alias("base_version")
    return rows.where(counted == number(5)).select(
        "line_id", "node_id", "engine", base, number(2).alias("version"), number(3).alias("timestamp_millis"), F.get("__f", F.lit(4)).alias("body")
    )


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("line_id", pa.int64()), ("engine", pa.string()), ("reason", pa.string())])
    for batch in batches:
        ids, engines, lines = (batch.column(i).to_pylist() for i in range(3))
        reasons = [walrecord.diagnose(line, engine)[0] for engine, line in zip(engines, lines, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(engines, pa.string()), pa.array(reasons, pa.string())], schema=schema)


def _not_blank(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("raw_line").isNotNull() & F.col("raw_line").rlike(r"[^ \t\r\n]"))


def judged(lines: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """Every line that is not blank and does not load strictly: line_id, engine, reason; a null reason means that it is
    sound.

    ``lines`` has line_id (unique), engine and raw_line. Null lines and lines of only space, tab, CR or LF are no lines.
    Only ids take part in the subtraction; the text is then read of the remainder alone.
    """
    there = _not_blank(lines).select("line_id", "engine", "raw_line")
    loaded = strict_load(lines) if loaded is None else loaded
    rest = there.select("line_id").join(loaded.select("line_id"), "line_id", "left_anti")
    numbered = join_counted(there, rest.where(F.col("line_id").isNotNull()), ["line_id"], "left_semi", F.col("line_id"))
    return numbered.unionByName(there.where(F.col("line_id").isNull())).mapInArrow(_judge, "line_id long, engine string, reason string")


def bad_lines(lines: DataFrame) -> DataFrame:
    """The lines that fail, with the first reason: line_id, reason. See :func:`judged`."""
    return judged(lines).where(F.col("reason").isNotNull()).select("line_id", "reason")


def good_lines(lines: DataFrame) -> DataFrame:
    """line_id and engine of all lines that load, in the writer's spelling or another correct one."""
    loaded = cut(strict_load(lines).select("line_id", "engine"))
    return loaded.unionByName(judged(lines, loaded).where(F.col("reason").isNull()).select("line_id", "engine"))
