"""Document sources and sinks: JSON lines under a field mapping, as a search store exports and imports them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, StructField, StructType, _parse_datatype_string

#: Spark's type for a field type of the store, and back.
TO_SPARK = {
    "boolean": "boolean", "keyword": "string", "text": "string", "long": "bigint", "integer": "int", "short": "smallint", "byte": "tinyint",
    "double": "double", "float": "float", "half_float": "float", "binary": "binary", "ip": "string",
    "geo_point": "struct<lat:double,lon:double>",
}
DATE_FORMATS = {
    "date": "date", "strict_date": "date", "strict_date_optional_time": "timestamp", "strict_date_optional_time_nanos": "timestamp",
    "epoch_millis": "timestamp",
}
TO_STORE = {
    "boolean": {"type": "boolean"}, "string": {"type": "keyword"}, "bigint": {"type": "long"}, "int": {"type": "integer"},
    "smallint": {"type": "short"}, "tinyint": {"type": "byte"}, "double": {"type": "double"}, "float": {"type": "float"},
    "date": {"type": "date", "format": "strict_date"}, "timestamp": {"type": "date", "format": "strict_date_optional_time_nanos"},
    "timestamp_ntz": {"type": "date", "format": "strict_date_optional_time_nanos"}, "binary": {"type": "binary", "doc_values": True},
}


def spark_schema(mapping: Mapping[str, Mapping]) -> StructType:
    """Schema of documents with these field properties; an alias has its target's type."""

    def kind(name: str, spec: Mapping) -> DataType:
        if "properties" in spec or spec.get("type", "object") == "object":
            return spark_schema(spec.get("properties", {}))
        if spec["type"] == "alias":
            target = mapping
            for part in spec["path"].split(".")[:-1]:
                target = target[part]["properties"]
            last = spec["path"].split(".")[-1]
            return kind(last, target[last])
        if spec["type"] == "date":
            found = DATE_FORMATS.get(str(spec.get("format", "strict_date_optional_time")).split("||")[0].strip())
        else:
            found = TO_SPARK.get(spec["type"])
        if found is None:
            raise ValueError(f"field {name!r} has a type that Spark cannot hold: {dict(spec)}")
        return _parse_datatype_string(found)

    return StructType([StructField(n, kind(n, s), metadata={"storeType": s.get("type", "object")}) for n, s in mapping.items()])


def store_mapping(schema: StructType) -> dict[str, dict]:
    """Field properties for a schema: arrays as their elements, decimals as doubles, maps as open objects."""

    def spec(field: StructField, kind: DataType) -> dict:
        if isinstance(kind, ArrayType):
            return spec(field, kind.elementType)
        if isinstance(kind, StructType):
            return {"properties": store_mapping(kind)}
        if isinstance(kind, DecimalType):
            return {"type": "double"}
        name = kind.simpleString()
        if name.startswith("map"):
            return {"type": "object"}
        wanted = (field.metadata or {}).get("storeType")
        if wanted in ("text", "ip", "half_float"):
            return {"type": wanted}
        if name not in TO_STORE:
            raise ValueError(f"field {field.name!r} has a type that the store cannot hold: {name}")
        return dict(TO_STORE[name])

    return {f.name: spec(f, f.dataType) for f in schema.fields}


def read_documents(spark: SparkSession, path: str, mapping: Mapping[str, Mapping]) -> DataFrame:
    """JSON lines as a table under the mapping; a broken line gives a row of nulls."""
    return spark.read.schema(spark_schema(mapping)).json(path)


def write_documents(df: DataFrame, path: str, *, id_column: str | None = None, batch_rows: int = 10_000) -> None:
    """JSON lines for a bulk import, ``batch_rows`` documents a file; with an id, its column goes along as ``_id``."""
    out = df.withColumnRenamed(id_column, "_id") if id_column else df
    out.write.option("maxRecordsPerFile", batch_rows).mode("append").json(path)


def geo_point(text: Column | str) -> Column:
    """A point from "lat,lon" or from "POINT (lon lat)": a struct of lat and lon; else null."""
    c = text if isinstance(text, Column) else F.col(text)
    number = r"(-?\d+(?:\.\d+)?)"
    pair, wkt = rf"^\s*{number}\s*,\s*{number}\s*$", rf"(?i)^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"

    def made(pattern: str, lat: int, lon: int) -> Column:
        return F.struct(
            F.regexp_extract(c, pattern, lat).try_cast("double").alias("lat"), F.regexp_extract(c, pattern, lon).try_cast("double").alias("lon")
        )

    return F.when(c.rlike(pair), made(pair, 1, 2)).when(c.rlike(wkt), made(wkt, 2, 1))
