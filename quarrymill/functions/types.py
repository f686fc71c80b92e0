"""Column types: what a type is called in a document and which family it belongs to."""

from __future__ import annotations

from pyspark.sql import types as T

_NAMES = {
    T.StringType: "VARCHAR", T.VarcharType: "VARCHAR", T.CharType: "VARCHAR", T.ByteType: "TINYINT", T.ShortType: "SMALLINT",
    T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.BooleanType: "BOOLEAN",
    T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP", T.BinaryType: "BLOB", T.MapType: "MAP",
    T.StructType: "STRUCT",
}


def render(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"{render(kind.elementType)}[]"
    return next((name for cls, name in _NAMES.items() if type(kind) is cls), "JSON")


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.VarcharType, T.CharType))


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) or type(kind).__name__ == "VariantType"


def is_orderable(kind: T.DataType) -> bool:
    return is_text(kind) or is_numeric(kind) or is_temporal(kind) or isinstance(kind, T.BooleanType)


def family(kind: T.DataType) -> str:
    """Columns join only within a family."""
    return "num" if is_numeric(kind) else "str" if is_text(kind) else "temporal" if is_temporal(kind) else "other"
