"""Row formats: JSON, changelog CSV, protobuf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode(lines: DataFrame, options: dict[str, str], schema: str) -> DataFrame:
    """Rows of a declared schema from a column `value`, by the option format."""
    kind = options.get("format", "json")
    if kind == "json":
        return _json(lines, schema, options)
    if kind == "changelog-csv":
        return changelog_csv(lines, schema, options.get("changelog-csv.column-delimiter", "|"))
    if kind in ("protobuf", "protobuf_v2"):
        from .protobuf import decode_messages

        return decode_messages(lines, schema, options["protobuf_v2.descriptor"], options["protobuf_v2.message-name"], options.get("protobuf_v2.ignore-parse-errors", "false") == "true")
    raise ValueError(f"unknown format {kind!r}")


def _json(lines: DataFrame, schema: str, options: dict[str, str]) -> DataFrame:
    strict = options.get("json.ignore-parse-errors", "false") != "true" and options.get("json.fail-on-missing-field") == "true"
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE", "timestampFormat": options.get("json.timestamp-format", "yyyy-MM-dd HH:mm:ss")}
    return lines.select(F.from_json(F.col("value").cast("string"), schema, mode).alias("_j")).where("_j IS NOT NULL").select("_j.*")


def json_rows(df: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """df with the fields of a JSON column beside it; text that is no JSON gives nulls."""
    parsed = df.withColumn("_j", F.from_json(F.col(column).cast("string"), schema))
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    return parsed.select(*df.columns, *[F.col("_j")[n].alias(n) for n in names])


def changelog_csv(lines: DataFrame, schema: str, delimiter: str = "|") -> DataFrame:
    """KIND|column|column...: INT and STRING columns, and `_op` with the row's kind."""
    fields = T._parse_datatype_string(schema).fields
    for f in fields:
        if not isinstance(f.dataType, (T.IntegerType, T.StringType)):
            raise TypeError(f"changelog-csv takes INT and STRING columns, not {f.name} {f.dataType.simpleString()}")
    literal = "".join("\\" + c if not c.isalnum() else c for c in delimiter)
    parts = F.split(F.col("value").cast("string"), literal, -1)
    return lines.select(parts.alias("_p")).select(F.col("_p")[0].alias("_op"), *[F.col("_p")[i + 1].cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])
