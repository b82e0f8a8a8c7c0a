"""Versioned index storage: immutable generations of parquet tables.

``gen=N/`` holds docs, postings (partitioned by context, sorted by word_lc within files) and contexts.json; a
generation counts once its ``_COMMITTED`` marker is there, so a failed write leaves the former one current. Paths go
through the Hadoop file system and may lie on any shared store.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from termloom.operators.analysis import POSTINGS
from termloom.operators.context_types import TYPES, ContextSchema
from termloom.plans.compiler import QueryError
from termloom.runtime import exists, names_in, read_text, write_text


class GenerationStore:
    def __init__(self, spark: SparkSession, path: str, codec: str = "zstd") -> None:
        self.spark, self.path, self.codec = spark, path.rstrip("/"), codec

    def generations(self) -> list[int]:
        names = [n for n in names_in(self.spark, self.path) if n.startswith("gen=") and n[4:].isdigit()]
        return sorted(int(n[4:]) for n in names if exists(self.spark, f"{self.path}/{n}/_COMMITTED"))

    def write(self, docs: DataFrame, postings: DataFrame, schemas: dict[str, ContextSchema], parent: int | None = None) -> int:
        """A new generation; 409 if another writer published one since ``parent``."""
        current = self.generations()
        if parent is not None and current and current[-1] != parent:
            raise QueryError(409, f"generation {current[-1]} was published since {parent}")
        # The first writer to create the claim owns the number; a number claimed by a failed writer stays unused.
        number = (current[-1] if current else 0) + 1
        while not write_text(self.spark, f"{self.path}/gen={number}/_CLAIMED", "", exclusive=True):
            if parent is not None:
                raise QueryError(409, f"generation {number} is being written")
            number += 1
        base = f"{self.path}/gen={number}"
        docs.write.mode("overwrite").option("compression", self.codec).parquet(f"{base}/docs")
        # Ranges end with the document, so a hot word spreads over several; files cover few words and are skipped whole.
        ordered = postings.repartitionByRange("context", "word_lc", "doc_id").sortWithinPartitions("context", "word_lc", "word", "doc_id")
        ordered.write.mode("overwrite").option("compression", self.codec).partitionBy("context").parquet(f"{base}/postings")
        write_text(self.spark, f"{base}/contexts.json", json.dumps({n: s.to_json() for n, s in schemas.items()}))
        write_text(self.spark, f"{base}/_COMMITTED", "")
        return number

    def read(self, generation: int | None = None) -> tuple[DataFrame, DataFrame, dict[str, ContextSchema], int]:
        """docs, postings, schemas and number of a generation (default: the newest)."""
        found = self.generations()
        if not found or (generation is not None and generation not in found):
            raise QueryError(404, f"no index at {self.path}" if generation is None else f"no generation {generation}")
        number = generation or found[-1]
        base = f"{self.path}/gen={number}"
        try:
            schemas = {n: ContextSchema.from_json(o) for n, o in json.loads(read_text(self.spark, f"{base}/contexts.json")).items()}
        except (ValueError, KeyError) as e:
            raise QueryError(500, f"contexts of generation {number} can't be read: {e}") from e
        unknown = [s.type for s in schemas.values() if s.type not in TYPES]
        if unknown:
            raise QueryError(500, f"unknown context types: {', '.join(unknown)}")
        order = [c.split()[0] for c in POSTINGS.split(", ")]
        postings = self.spark.read.schema(POSTINGS).parquet(f"{base}/postings").select(*order)
        return self.spark.read.parquet(f"{base}/docs"), postings, schemas, number
