"""Packed value series: big-endian fixed-width values, or length-prefixed bytes, and their native form, arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: SQL type to (numpy big-endian type or None for length-prefixed, Spark element type).
KINDS = {
    "BOOLEAN": ("?", "boolean"), "TINYINT": (">i1", "tinyint"), "SMALLINT": (">i2", "smallint"), "INT": (">i4", "int"), "INTEGER": (">i4", "int"),
    "BIGINT": (">i8", "bigint"), "FLOAT": (">f4", "float"), "DOUBLE": (">f8", "double"), "DATE": (">i4", "int"), "TIME": (">i4", "int"),
    "STRING": (None, "string"), "VARCHAR": (None, "string"), "CHAR": (None, "string"), "BINARY": (None, "binary"), "VARBINARY": (None, "binary"), "BYTES": (None, "binary"),
}


def pack(values, kind: str) -> bytes:
    """Values, without nulls, as packed bytes."""
    code, _ = KINDS[kind.upper()]
    values = [v for v in values if v is not None]
    if code:
        return np.array(values, dtype=code).tobytes()
    out = bytearray()
    for v in values:
        data = v.encode() if isinstance(v, str) else bytes(v)
        n = len(data)
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
        out += data
    return bytes(out)


def unpack(data: bytes | None, kind: str) -> list | None:
    """Packed bytes back to a list; null stays null."""
    if data is None:
        return None
    code, element = KINDS[kind.upper()]
    if code:
        return np.frombuffer(data, dtype=code).tolist()
    out, i = [], 0
    while i < len(data):
        n = shift = 0
        while True:
            byte = data[i]
            i += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        part = bytes(data[i : i + n])
        out.append(part.decode() if element == "string" else part)
        i += n
    return out


def decode_series(kind: str):
    """A vectorised function from packed bytes to an array of the kind."""

    @F.pandas_udf(f"array<{KINDS[kind.upper()][1]}>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: unpack(x, kind))

    return run


def encode_series(kind: str):
    """A vectorised function from arrays to packed bytes."""

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else pack(list(x), kind))

    return run


def decode_column(df: DataFrame, column: str, kind: str | None) -> Column:
    """An array column as it is, or packed bytes of the given kind decoded."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.col(column)
    if not kind:
        raise ValueError(f"the type of the packed values of {column} is needed")
    return decode_series(kind)(F.col(column))


#: session_<kind>_collect functions, by the type they give.
COLLECTS = {"bool": "BOOLEAN", "byte": "TINYINT", "short": "SMALLINT", "int": "INT", "long": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "string": "STRING", "binary": "BINARY"}


def collect_function(kind: str):
    """session_<kind>_collect for SQL: packed bytes to an array."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(lambda x: unpack(x, COLLECTS[kind]))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, f"array<{KINDS[COLLECTS[kind]][1]}>")
