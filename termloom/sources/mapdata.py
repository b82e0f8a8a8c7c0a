"""Map data in XML (nodes with coordinates and tags) as ingest records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "_id bigint, _lat double, _lon double, tag array<struct<_k string, _v string>>"


def read_nodes(spark: SparkSession, path: str, tags: list[str], stop_tags: tuple[str, ...] = (), prefix: str = "osm://") -> DataFrame:
    """Named nodes that carry one of ``tags`` and none of ``stop_tags``: contexts name, kind, position (lat-long) and one
    for each tag of ``tags``."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema(NODE).load(path)
    held = F.map_from_entries(F.transform("tag", lambda t: F.struct(t["_k"], t["_v"])))
    rows = nodes.where("tag is not null and size(tag) > 0").select("_id", "_lat", "_lon", held.alias("t"))
    wanted = F.map_filter("t", lambda k, _: k.isin(tags))
    rows = rows.where(F.map_contains_key("t", F.lit("name")) & (F.size(wanted) > 0))
    if stop_tags:
        rows = rows.where(F.size(F.map_filter("t", lambda k, _: k.isin(list(stop_tags)))) == 0)
    place = F.format_string("%.5f-%.5f", "_lat", "_lon")
    own = F.create_map(F.lit("name"), F.col("t")["name"], F.lit("kind"), F.array_join(F.map_keys(wanted), " "), F.lit("position"), place)
    extra = F.map_filter(wanted, lambda k, _: ~k.isin("name", "kind", "position"))
    described = F.transform_values("t", lambda _, v: F.substring(F.to_json(F.array(v)), F.lit(2), F.length(F.to_json(F.array(v))) - 2))
    return rows.select(F.concat(F.lit(prefix), F.col("_id").cast("string")).alias("uri"), F.map_concat(own, extra).alias("index"), described.alias("description"), F.lit(None).cast("double").alias("weight"))
