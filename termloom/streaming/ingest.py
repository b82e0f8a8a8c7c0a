"""Live ingest: a stream of JSON records into an engine, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.operators.engine import Engine
from termloom.sources.documents import parse_json


def upsert(engine: Engine, batch: DataFrame) -> None:
    """New URIs are inserted, known ones updated; the last of a batch's records of one URI counts."""
    from termloom.operators.analysis import doc_key

    last = batch.groupBy("uri").agg(F.max_by(F.struct("index", "description", "weight"), "seq").alias("r")).select("uri", "r.*") if "seq" in batch.columns else batch.dropDuplicates(["uri"])
    keyed = last.withColumn("_id", doc_key(F.col("uri")))
    known = engine.docs.select(F.col("doc_id").alias("_id"))
    new, old = keyed.join(known, "_id", "left_anti").drop("_id"), keyed.join(known, "_id", "left_semi").drop("_id")
    from termloom.runtime import checkpointed

    new, old = checkpointed(new), checkpointed(old)
    if old.limit(1).count():
        engine.update(old)
    if new.limit(1).count():
        engine.insert(new)


def stream_json(spark: SparkSession, engine: Engine, source: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Text files of JSON records arriving in ``source`` go through ``upsert``."""
    lines = spark.readStream.text(source)
    writer = lines.writeStream.foreachBatch(lambda batch, _: upsert(engine, parse_json(batch))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
