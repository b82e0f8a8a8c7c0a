"""The engine: a catalog of contexts, documents and postings, and the commands on it.

Every change builds new DataFrames and swaps the catalog's pointers at its end, so queries see snapshots and a failed
command changes nothing. What a batch adds is written once to the shared folder, so queries don't analyse it again;
every ``checkpoint_every`` changes the whole index is rewritten there.
"""

from __future__ import annotations

import gc
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.normalize import NORMALIZERS
from termloom.operators import analysis, ranking
from termloom.operators.context_types import TYPES, ContextSchema
from termloom.plans import query as Q
from termloom.plans.compiler import Compiler, ProcessConfig, QueryError
from termloom.plans.parser import ParseError, parse
from termloom.runtime import checkpointed
from termloom.sources.documents import RECORD, error_json
from termloom.sources.store import GenerationStore

DOCS = "doc_id bigint, uri string, description map<string,string>, weight double"


class Engine:
    def __init__(self, spark: SparkSession, schemas: dict[str, ContextSchema] | None = None, config: ProcessConfig = ProcessConfig(), checkpoint_every: int = 4) -> None:
        self.spark, self.config = spark, config
        self.schemas: dict[str, ContextSchema] = dict(schemas or {})
        self.docs = spark.createDataFrame([], DOCS)
        self.postings = spark.createDataFrame([], analysis.POSTINGS)
        self.checkpoint_every, self._changes = checkpoint_every, 0
        self._loaded: dict[str, int] = {}

    # -- state

    def _publish(self, docs: DataFrame, postings: DataFrame) -> None:
        self._changes += 1
        if self._changes % self.checkpoint_every == 0:
            docs, postings = checkpointed(docs), checkpointed(postings)
        self.docs, self.postings = docs, postings

    def compiler(self, config: ProcessConfig | None = None) -> Compiler:
        return Compiler(self.postings, self.schemas, config or self.config)

    @staticmethod
    def _query(q: Q.Query | str) -> Q.Query:
        try:
            return parse(q) if isinstance(q, str) else q
        except ParseError as e:
            raise QueryError(400, str(e)) from e

    # -- contexts

    def insert_context(self, name: str, schema: ContextSchema) -> None:
        if name in self.schemas:
            raise QueryError(409, f"context already exists: {name}")
        if schema.type not in TYPES:
            raise QueryError(410, f"unknown type: {schema.type}")
        unknown = [n for n in schema.normalizers if n not in NORMALIZERS]
        if unknown:
            raise QueryError(410, f"unknown normalizer: {', '.join(unknown)}")
        self.schemas = self.schemas | {name: schema}

    def delete_context(self, name: str) -> None:
        """An absent context is none to delete."""
        if name in self.schemas:
            self.schemas = {n: s for n, s in self.schemas.items() if n != name}
            self._publish(self.docs, self.postings.where(F.col("context") != name))

    # -- documents

    def _records(self, records: DataFrame | list[dict]) -> DataFrame:
        if isinstance(records, DataFrame):
            return records
        return self.spark.createDataFrame([(r["uri"], r.get("index"), r.get("description"), None if r.get("weight") is None else float(r["weight"])) for r in records], RECORD)

    def _check_contexts(self, raw: DataFrame) -> None:
        used = raw.select(F.explode(F.map_keys("index")).alias("c")).distinct().where(~F.col("c").isin(list(self.schemas)) if self.schemas else F.lit(True))
        missing = [r[0] for r in used.limit(20).collect()]
        if missing:
            raise QueryError(409, f"required contexts are not present: {', '.join(sorted(missing))}")

    def insert(self, records: DataFrame | list[dict]) -> None:
        """409 for unknown contexts, URIs repeated in the batch, or URIs already there; all checked before any write."""
        raw = self._records(records)
        self._check_contexts(raw)
        twice = [r[0] for r in self.duplicate_uris(raw).limit(20).collect()]
        if twice:
            raise QueryError(409, f"duplicate uris: {', '.join(sorted(twice))}")
        new = checkpointed(analysis.documents(raw))
        there = [r[0] for r in new.select("doc_id", "uri").join(self.docs.select("doc_id"), "doc_id", "left_semi").select("uri").limit(20).collect()]
        if there:
            raise QueryError(409, f"documents already exist: {', '.join(sorted(there))}")
        self._publish(self.docs.unionByName(new.drop("index")), self.postings.unionByName(checkpointed(analysis.postings(new, self.schemas))))

    @staticmethod
    def duplicate_uris(raw: DataFrame) -> DataFrame:
        return raw.groupBy("uri").agg(F.count("*").alias("n")).where("n > 1").select("uri", "n")

    def update(self, records: DataFrame | list[dict], order: str | None = None) -> None:
        """409 if a URI is not there. Descriptions merge (new fields win, null removes), a set weight replaces, words
        are added to those already found. A URI that comes again in a list, or in a DataFrame with a column ``order``,
        is updated by each of its records in order; in a DataFrame without one that is 409."""
        if not isinstance(records, DataFrame):
            order = "_order"
            numbered = [(n, r["uri"], r.get("index"), r.get("description"), None if r.get("weight") is None else float(r["weight"])) for n, r in enumerate(records)]
            raw = self.spark.createDataFrame(numbered, f"_order long, {RECORD}")
        else:
            raw = records
        self._check_contexts(raw)
        if order is None:
            twice = [r[0] for r in self.duplicate_uris(raw).limit(20).collect()]
            if twice:
                raise QueryError(409, f"duplicate uris: {', '.join(sorted(map(str, twice)))}")
        empty = F.create_map().cast("map<string,string>")
        folded = raw if order is None else self._folded(raw, order)
        change = folded.select(analysis.doc_key(F.col("uri")).alias("doc_id"), "uri", F.coalesce("description", empty).alias("new"), F.when(F.col("weight") > 0, F.col("weight").cast("double")).alias("new_weight"))
        absent = [r[0] for r in change.join(self.docs.select("doc_id"), "doc_id", "left_anti").select("uri").limit(20).collect()]
        if absent:
            raise QueryError(409, f"documents do not exist: {', '.join(sorted(absent))}")
        # Only the touched documents are merged; those of all others pass by an anti-join that doesn't group them.
        change = checkpointed(change.drop("uri"))
        ids = change.select("doc_id")
        merged = self.docs.join(change, "doc_id").select("doc_id", "uri", ranking.merge(F.col("description"), F.col("new")).alias("description"), F.coalesce("new_weight", "weight").alias("weight"))
        added = checkpointed(analysis.postings(analysis.documents(raw), self.schemas))
        touched = merge_postings(self.postings.join(ids, "doc_id", "left_semi").select(added.columns), added)
        untouched = self.postings.join(ids, "doc_id", "left_anti").select(added.columns)
        self._publish(self.docs.join(ids, "doc_id", "left_anti").unionByName(merged), untouched.unionByName(touched))

    @staticmethod
    def _folded(raw: DataFrame, order: str) -> DataFrame:
        """uri, description, weight: one row per URI, the last value of each field and the last set weight. Fields are
        grouped, not records, so no URI's records gather in one row."""
        fields = raw.select("uri", order, F.explode("description").alias("field", "value")).groupBy("uri", "field").agg(F.max_by("value", order).alias("value"))
        described = fields.groupBy(F.col("uri").alias("_uri")).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("description"))
        weights = raw.groupBy("uri").agg(F.max_by("weight", F.when(F.col("weight") > 0, F.col(order))).alias("weight"))
        return weights.join(described, F.col("uri").eqNullSafe(F.col("_uri")), "left").drop("_uri")

    def delete(self, uris: list[str] | DataFrame) -> None:
        """Unknown URIs are ignored."""
        gone = uris if isinstance(uris, DataFrame) else self.spark.createDataFrame([(u,) for u in uris], "uri string")
        self._delete_ids(gone.select(analysis.doc_key(F.col("uri")).alias("doc_id")).distinct())

    def _delete_ids(self, ids: DataFrame) -> None:
        self._publish(self.docs.join(ids, "doc_id", "left_anti"), self.postings.join(ids, "doc_id", "left_anti"))

    def delete_by_query(self, q: Q.Query | str) -> None:
        unlimited = ProcessConfig(0, self.config.strict_boost, self.config.expand_fuzzy, self.config.fuzzy)
        self._delete_ids(checkpointed(self.compiler(unlimited).unscored(self._query(q))))

    # -- queries

    def results(self, q: Q.Query | str) -> DataFrame:
        """All hits with their documents, unordered."""
        return ranking.with_documents(self.compiler().scored(self._query(q)), self.docs)

    def search(self, q: Q.Query | str, offset: int = 0, most: int = -1, fields: list[str] | None = None, weight: bool = False) -> DataFrame:
        hits = ranking.weighted(self.compiler().scored(self._query(q)), self.docs)
        return ranking.projected(ranking.described_page(hits, self.docs, offset, most), fields, weight)

    def weight(self, q: Q.Query | str, offset: int = 0, most: int = -1) -> DataFrame:
        """A search that shows the documents' weights and nothing of their descriptions."""
        return self.search(q, offset, most, fields=[], weight=True)

    def count(self, q: Q.Query | str) -> int:
        return self.compiler().scored(self._query(q)).join(self.docs.select("doc_id"), "doc_id", "left_semi").count()

    def completion(self, q: Q.Query | str, most: int = -1) -> DataFrame:
        return ranking.top_words(self.compiler().completions(self._query(q)), most)

    def select(self, q: Q.Query | str) -> DataFrame:
        """Unranked documents, all of them."""
        unlimited = ProcessConfig(0, self.config.strict_boost, self.config.expand_fuzzy, self.config.fuzzy)
        return self.docs.join(self.compiler(unlimited).unscored(self._query(q)), "doc_id", "left_semi")

    def lookup(self, uris: list[str]) -> DataFrame:
        keys = self.spark.createDataFrame([(u,) for u in uris], "uri string").select(analysis.doc_key(F.col("uri")).alias("doc_id"))
        return self.docs.join(keys, "doc_id", "left_semi")

    # -- maintenance

    def store(self, path: str) -> int:
        """A new generation; 409 for an index opened from an older generation of this path than its newest."""
        number = GenerationStore(self.spark, path).write(self.docs, self.postings, self.schemas, self._loaded.get(path))
        self._loaded[path] = number
        return number

    def load(self, path: str, generation: int | None = None) -> None:
        self.docs, self.postings, self.schemas, self._loaded[path] = GenerationStore(self.spark, path).read(generation)

    def unite(self, other: Engine) -> None:
        """Take in another index with the same contexts; 409 if a document is in both."""
        both = self.docs.join(other.docs.select("doc_id"), "doc_id", "left_semi").limit(20).collect()
        if both:
            raise QueryError(409, f"documents are in both: {', '.join(sorted(str(r['uri']) for r in both))}")
        self.schemas = other.schemas | self.schemas
        self._publish(self.docs.unionByName(other.docs), self.postings.unionByName(other.postings))

    def answer(self, command: dict | list) -> dict:
        """``execute`` as a server answers: code 0 and the result, or the error's code and message."""
        try:
            return {"code": 0, "res": self.execute(command)}
        except QueryError as e:
            return error_json(e.code, e.message)

    def status(self, what: str, context: str | None = None) -> Any:
        match what:
            case "gc":
                return {"collected": gc.collect()}
            case "doctable":
                return self.docs
            case "index":
                return analysis.vocabulary(self.postings)
            case "context":
                if context not in self.schemas:
                    raise QueryError(404, f"context is not present: {context}")
                return analysis.vocabulary(self.postings.where(F.col("context") == context))
        raise QueryError(400, f"unknown status: {what}")

    # -- JSON commands

    def execute(self, command: dict | list) -> Any:
        """One command, or a sequence of them: in order, up to the first error, without rollback; the last's result.
        Neighbouring inserts and deletes of a sequence go as one batch."""
        if isinstance(command, list):
            result = None
            for c in batched(command):
                result = self.execute(c)
            return result
        match command.get("cmd"):
            case "search":
                q, offset, most = Q.from_json(command["query"]) if isinstance(command["query"], dict) else command["query"], command.get("offset", 0), command.get("max", -1)
                # Evaluated once, for the page and for the count.
                hits = checkpointed(ranking.weighted(self.compiler().scored(self._query(q)), self.docs))
                rows = ranking.projected(ranking.described_page(hits, self.docs, offset, most), command.get("fields"), command.get("weight", False))
                return {"result": rows, "offset": offset, "max": most, "count": hits.count()}
            case "completion":
                return self.completion(Q.from_json(command["text"]) if isinstance(command["text"], dict) else command["text"], command.get("max", -1))
            case "select":
                return self.select(Q.from_json(command["query"]) if isinstance(command["query"], dict) else command["query"])
            case "insert":
                return self.insert(_documents(command))
            case "update":
                return self.update(_documents(command))
            case "delete":
                return self.delete(command["uri"] if isinstance(command["uri"], list) else [command["uri"]])
            case "delete-by-query":
                return self.delete_by_query(Q.from_json(command["query"]) if isinstance(command["query"], dict) else command["query"])
            case "insert-context":
                return self.insert_context(command["context"], ContextSchema.from_json(command["schema"]))
            case "delete-context":
                return self.delete_context(command["context"])
            case "store":
                return self.store(command["path"])
            case "load":
                return self.load(command["path"])
            case "status":
                return self.status(*([command["status"]] if isinstance(command["status"], str) else command["status"]))
            case "noop":
                return None
        raise QueryError(400, f"unknown command: {command.get('cmd')}")


def _documents(command: dict) -> list[dict]:
    import json

    docs = command["document"] if isinstance(command["document"], list) else [command["document"]]
    return [d | {"description": {k: json.dumps(v, ensure_ascii=False) for k, v in (d.get("description") or {}).items()}} for d in docs]


def batched(commands: list, most: int = 1000) -> list:
    """Neighbouring inserts and neighbouring deletes joined, at most ``most`` together; order kept."""
    out: list = []
    for c in commands:
        kind = c.get("cmd") if isinstance(c, dict) else None
        key = {"insert": "document", "delete": "uri"}.get(kind)
        if key and out and isinstance(out[-1], dict) and out[-1].get("cmd") == kind:
            as_list = lambda x: x if isinstance(x, list) else [x]
            together = as_list(out[-1][key]) + as_list(c[key])
            if len(together) <= most:
                out[-1] = out[-1] | {key: together}
                continue
        out.append(c)
    return out


def merge_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two posting tables: positions of the same word and document are united."""
    keys = ["context", "word", "word_lc", "doc_id"]
    both = old.unionByName(new)
    positions = F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions"))))
    merged = both.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in analysis.TYPED], F.max(F.col("positions").isNotNull()).alias("has"), positions.alias("all"))
    kept = F.when(F.col("has"), F.col("all"))
    order = [c.split()[0] for c in analysis.POSTINGS.split(", ")]
    return merged.withColumn("positions", kept).withColumn("tf", F.when(F.col("has"), F.size("all")).otherwise(1)).select(*order)
