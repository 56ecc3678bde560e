"""protobuf messages to rows and back, from a descriptor set; only the fields that the table lists are converted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def message_class(descriptor: bytes | str, name: str):
    """A message class of a serialised FileDescriptorSet (bytes, or the path of a file with them)."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    if isinstance(descriptor, str):
        with open(descriptor, "rb") as f:
            descriptor = f.read()
    pool = descriptor_pool.DescriptorPool()
    for file in descriptor_pb2.FileDescriptorSet.FromString(descriptor).file:
        pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(name))


def _value(v, field, kind: T.DataType):
    if field.message_type is not None and field.message_type.GetOptions().map_entry:
        value = field.message_type.fields_by_name["value"]
        return {k: _single(x, value, kind.valueType) for k, x in v.items()}
    if isinstance(kind, T.ArrayType):
        return [_single(x, field, kind.elementType) for x in v]
    return _single(v, field, kind)


def _single(v, field, kind: T.DataType):
    if isinstance(kind, T.StructType):
        return {f.name: _value(getattr(v, f.name), v.DESCRIPTOR.fields_by_name[f.name], f.dataType) for f in kind.fields}
    if field.enum_type is not None:
        return field.enum_type.values_by_number[v].name if isinstance(kind, T.StringType) else int(v)
    if isinstance(kind, T.StringType) and isinstance(v, bytes):
        return v.decode("utf-8", "replace")
    if isinstance(kind, T.BinaryType) and isinstance(v, str):
        return v.encode()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(v)
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return int(v)
    return v


def check_fields(schema: T.StructType, descriptor) -> None:
    for f in schema.fields:
        if f.name not in descriptor.fields_by_name:
            raise ValueError(f"message {descriptor.name} has no field {f.name}")


def decode_messages(df: DataFrame, schema: str, descriptor: bytes | str, name: str, ignore_errors: bool = False, column: str = "value") -> DataFrame:
    """Rows of the schema from a binary column: absent fields have their type's default; bytes that are no message are null
    rows if errors are ignored, else an error."""
    kind = T._parse_datatype_string(schema)
    if isinstance(descriptor, str):
        with open(descriptor, "rb") as f:
            descriptor = f.read()
    check_fields(kind, message_class(descriptor, name).DESCRIPTOR)

    def run(frames):
        make = message_class(descriptor, name)
        for frame in frames:
            rows = []
            for data in frame[column]:
                try:
                    m = make.FromString(bytes(data))
                    rows.append({f.name: _value(getattr(m, f.name), make.DESCRIPTOR.fields_by_name[f.name], f.dataType) for f in kind.fields})
                except Exception as e:  # noqa: BLE001  the decoder's errors have no common class
                    if not ignore_errors:
                        raise OSError(f"cannot decode {name}") from e
                    rows.append(dict.fromkeys(kind.names))
            yield pd.DataFrame(rows, columns=kind.names, dtype=object)

    return df.select(column).mapInPandas(run, kind)


def encode_messages(df: DataFrame, descriptor: bytes | str, name: str, column: str = "value") -> DataFrame:
    """A binary column from all columns of df; nulls are left out."""
    if isinstance(descriptor, str):
        with open(descriptor, "rb") as f:
            descriptor = f.read()

    def run(frames):
        make = message_class(descriptor, name)
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                m = make()
                for k, v in row.items():
                    if v is None or (isinstance(v, float) and pd.isna(v)):
                        continue
                    field = make.DESCRIPTOR.fields_by_name[k]
                    if hasattr(v, "__len__") and not isinstance(v, (str, bytes, dict)):
                        getattr(m, k).extend(list(v))
                    elif isinstance(v, dict):
                        getattr(m, k).update(v)
                    else:
                        setattr(m, k, field.enum_type.values_by_name[v].number if field.enum_type is not None and isinstance(v, str) else v)
                out.append(m.SerializeToString())
            yield pd.DataFrame({column: out})

    return df.mapInPandas(run, T.StructType([T.StructField(column, T.BinaryType())]))
