"""Logical types, and the type in which two operands meet.

Spark has no unsigned integers: u8, u16 and u32 live in the next wider signed type, u64 in decimal(20, 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Logical name to Spark type.
SPARK = {
    "bool": "boolean", "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint",
    "u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)",
    "f16": "float", "f32": "float", "f64": "double", "utf8": "string", "binary": "binary",
}
_BACK = {"boolean": "bool", "tinyint": "i8", "smallint": "i16", "int": "i32", "bigint": "i64", "decimal(20,0)": "u64", "float": "f32", "double": "f64", "string": "utf8", "binary": "binary"}


class UnsupportedType(TypeError):
    """An operator got a type that it isn't defined for."""


def logical(kind: T.DataType | str) -> str:
    """The logical name of a Spark type; lists are 'list<item>'."""
    if isinstance(kind, str):
        if kind in SPARK or kind.startswith("list<"):
            return kind
        kind = T._parse_datatype_string(kind)
    if isinstance(kind, T.ArrayType):
        return f"list<{logical(kind.elementType)}>"
    if kind.simpleString() not in _BACK:
        raise UnsupportedType(f"no operator takes {kind.simpleString()}")
    return _BACK[kind.simpleString()]


def spark_type(name: str) -> str:
    """The Spark type that holds a logical type."""
    if name.startswith("list<"):
        return f"array<{spark_type(name[5:-1])}>"
    return SPARK[name]


def is_float(name: str) -> bool:
    return name[0] == "f"


def is_integer(name: str) -> bool:
    return name[0] in "iu" and name[1:].isdigit()


def is_signed(name: str) -> bool:
    return name[0] == "i"


def bits(name: str) -> int:
    return int(name[1:])


def bounds(name: str) -> tuple[int, int]:
    """Least and greatest value of an integer type."""
    n = bits(name)
    return (-(1 << n - 1), (1 << n - 1) - 1) if is_signed(name) else (0, (1 << n) - 1)


def dominant_type(left: str, right: str) -> str:
    """The type in which operands of two types are compared or computed.

    Equal types stay.  Lists meet lists of their kind only, strings and bytes each other.  A float with
    anything else is f64; integers of either sign meet in i64; else the wider one wins.
    """
    if left == right:
        return left
    if left.startswith("list<") or right.startswith("list<"):
        raise UnsupportedType(f"{left} and {right} don't meet: lists must have one type")
    texts = {"utf8", "binary"}
    if left in texts or right in texts:
        if {left, right} == texts:
            return "utf8"
        raise UnsupportedType(f"{left} and {right} don't meet")
    if is_float(left) or is_float(right):
        return "f64"
    if "bool" in (left, right):
        return right if left == "bool" else left
    if is_signed(left) != is_signed(right):
        return "i64"
    return max(left, right, key=bits)


def widened(name: str) -> str:
    """The type of a grouped sum."""
    if is_float(name):
        return "f64"
    if is_integer(name):
        return "i64" if is_signed(name) else "u64"
    raise UnsupportedType(f"{name} can't be summed")


def logical_type(df: DataFrame, column: str) -> str:
    return logical(df.schema[column].dataType)


def dictionary_schema(key: str, value: str) -> T.StructType:
    """Of a dictionary: keys and their values."""
    return T.StructType([T.StructField("key", T._parse_datatype_string(spark_type(key))), T.StructField("value", T._parse_datatype_string(spark_type(value)))])


def run_end_schema(value: str) -> T.StructType:
    """Of a run-end table: ends (exclusive) and values."""
    return T.StructType([T.StructField("run_end", T.LongType()), T.StructField("value", T._parse_datatype_string(spark_type(value)))])


def empty_for(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """A table of no rows."""
    return spark.createDataFrame([], schema)
