"""Ingest records: JSON and CSV readers, JSON writers."""

from __future__ import annotations

import json
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: uri, index, description and weight of an ingest record.
RECORD = "uri string, index map<string,string>, description map<string,string>, weight double"
_RAW = "uri string, index map<string,string>, description map<string,variant>, weight double"


def _fragments(df: DataFrame) -> DataFrame:
    return df.where("uri is not null").select("uri", "index", F.transform_values("description", lambda _, v: F.to_json(v)).alias("description"), "weight")


def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON records, one a line (or arrays with ``multi_line``); records without a URI are left out."""
    return _fragments(spark.read.schema(_RAW).option("multiLine", multi_line).json(path))


def parse_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records from a column of JSON texts."""
    parsed = lines.select(F.from_json(column, _RAW).alias("r")).where("r is not null").select("r.*")
    return _fragments(parsed)


def to_json_lines(docs: DataFrame) -> DataFrame:
    """One JSON record a row in ``value``; empty maps and a weight of 1 or 0 are left out."""
    full = F.transform_values("description", lambda _, v: F.try_parse_json(v))
    fields = [F.col("uri")]
    if "index" in docs.columns:
        fields.append(F.when(F.size("index") > 0, F.col("index")).alias("index"))
    fields.append(F.when(F.size("description") > 0, full).alias("description"))
    fields.append(F.when((F.col("weight") != 1.0) & (F.col("weight") > 0), F.col("weight")).alias("weight"))
    if "score" in docs.columns:
        fields.append(F.col("score"))
    return docs.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("value"))


def write_json(docs: DataFrame, path: str, compression: str = "none") -> None:
    to_json_lines(docs).write.option("compression", compression).text(path)


def read_csv(spark: SparkSession, path: str, uri: str, index: list[str], description: list[str] | None = None, weight: str | None = None, **options: Any) -> DataFrame:
    """A CSV file with a header as ingest records: columns to contexts and to description fields."""
    return from_table(spark.read.options(header=True, **options).csv(path), uri, index, description, weight)


def from_table(df: DataFrame, uri: str, index: list[str], description: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Any table as ingest records. Null values give no entry."""
    texts = lambda names: F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))]), lambda _, v: v.isNotNull()) if names else F.create_map().cast("map<string,string>")
    described = F.transform_values(texts(description or []), lambda _, v: F.substring(F.to_json(F.array(v)), F.lit(2), F.length(F.to_json(F.array(v))) - 2))
    return df.select(F.col(uri).cast("string").alias("uri"), texts(index).alias("index"), described.alias("description"), (F.col(weight).cast("double") if weight else F.lit(None).cast("double")).alias("weight"))


def write_output(value: Any, target: str = "-") -> None:
    """Pretty JSON to a file, or to standard output for '' and '-'."""
    text = json.dumps(value, indent=2, ensure_ascii=False, default=str)
    if target in ("", "-"):
        sys.stdout.write(text + "\n")
    else:
        with open(target, "w", encoding="utf-8") as f:
            f.write(text)


def result_json(rows: list, offset: int, most: int, count: int) -> dict:
    return {"code": 0, "res": {"result": rows, "offset": offset, "max": most, "count": count}}


def error_json(code: int, message: str) -> dict:
    return {"code": code, "msg": message}
