"""The four types of the dialect and how expressions of them meet."""

from __future__ import annotations

from pyspark.sql import types as T

SPARK = {"int": T.LongType(), "float": T.DoubleType(), "text": T.StringType(), "bool": T.BooleanType(), "null": T.StringType()}
SHOWN = {"int": "INTEGER", "float": "FLOAT", "text": "TEXT", "bool": "BOOLEAN"}
NUMERIC = ("int", "float")


def of_field(kind: T.DataType) -> str:
    """The dialect's type of a Spark type; types that it lacks keep their Spark name and can only be passed on."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.BooleanType):
        return "bool"
    return kind.simpleString()


def comparable(a: str, b: str) -> bool:
    return a == b or "null" in (a, b) or (a in NUMERIC and b in NUMERIC)


def coercible(source: str, target: str) -> bool:
    """Whether a value can be written to a column: the same type, NULL, or a whole number to FLOAT."""
    return source == target or source == "null" or (source, target) == ("int", "float")


def value_type(value: object) -> str:
    """Type of a Python value bound to a parameter."""
    if value is None:
        return "null"
    for python, kind in ((bool, "bool"), (int, "int"), (float, "float"), (str, "text")):
        if isinstance(value, python):
            return kind
    raise TypeError(f"a {type(value).__name__} has no type in the dialect")
