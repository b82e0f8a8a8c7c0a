"""Documents to postings: scan, validate, number, normalise, invert.

Postings: context, word, word_lc, key_int, key_ts, lat, lon, doc_id, positions (null for types without), tf.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.normalize import normalise
from termloom.functions.text import scan
from termloom.operators.context_types import ContextSchema

POSTINGS = "context string, word string, word_lc string, key_int bigint, key_ts timestamp_ntz, lat double, lon double, doc_id bigint, positions array<int>, tf int"
TYPED = {"key_int": "bigint", "key_ts": "timestamp_ntz", "lat": "double", "lon": "double"}


def doc_key(uri: Column) -> Column:
    """Deterministic document id of a URI."""
    return F.xxhash64(uri)


def documents(raw: DataFrame, doc_id: Column | None = None) -> DataFrame:
    """doc_id, uri, index, description, weight of ingest records (uri, index, description, weight): missing maps are
    empty, null description fields go, a weight of at most 0 or none is 1."""
    empty = F.create_map().cast("map<string,string>")
    weight = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(1.0)
    described = F.map_filter(F.coalesce("description", empty), lambda _, v: v.isNotNull() & (F.trim(v) != "null"))
    return raw.select((doc_id if doc_id is not None else doc_key(F.col("uri"))).alias("doc_id"), "uri", F.coalesce("index", empty).alias("index"), described.alias("description"), weight.alias("weight"))


def _words(text: Column, schema: ContextSchema) -> Column:
    """Valid words of one context's text, before normalisation."""
    if schema.type in ("text", "text-small"):
        return scan(text, schema.pattern)  # valid as they are not empty
    return F.filter(scan(text, schema.pattern), lambda w: F.coalesce(schema.kind.valid(w), F.lit(False)))


def tokens(docs: DataFrame, schemas: dict[str, ContextSchema]) -> DataFrame:
    """context, doc_id, pos (from 1), word: one scan of the documents for all contexts."""
    entry = F.explode(F.map_entries(F.map_filter("index", lambda k, v: k.isin(list(schemas)) & v.isNotNull()))).alias("e")
    rows = docs.select("doc_id", entry).select("doc_id", F.col("e.key").alias("context"), F.col("e.value").alias("text"))
    by_context = lambda f: reduce(lambda acc, n: acc.when(F.col("context") == n, f(schemas[n])), list(schemas)[1:], F.when(F.col("context") == next(iter(schemas)), f(schemas[next(iter(schemas))])))
    if not schemas:
        return rows.select("context", "doc_id", F.lit(0).alias("pos"), F.col("text").alias("word")).where("false")
    found = rows.select("context", "doc_id", F.posexplode(by_context(lambda s: _words(F.col("text"), s))).alias("pos", "raw"))
    return found.select("context", "doc_id", (F.col("pos") + 1).alias("pos"), by_context(lambda s: normalise(F.col("raw"), list(s.normalizers))).alias("word"))


def postings(docs: DataFrame, schemas: dict[str, ContextSchema], boring: Callable[[Column], Column] | list[str] | None = None) -> DataFrame:
    """Inverted documents. The group key ends with doc_id, so a hot word never gathers in one task."""
    numbered = tokens(docs, schemas)
    if boring:
        numbered = without_words(numbered, boring)
    rows = numbered.groupBy("context", "word", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    keeps = [n for n, s in schemas.items() if s.kind.positions]
    typed = {}
    for column, kind in TYPED.items():
        value = F.lit(None).cast(kind)
        for n, s in schemas.items():
            own = s.kind.columns(_plain(F.col("word"), s)).get(column)
            if own is not None:
                value = F.when(F.col("context") == n, own).otherwise(value)
        typed[column] = value.cast(kind)
    positional = F.col("context").isin(keeps) if keeps else F.lit(False)
    return rows.select(
        "context", "word", F.lower("word").alias("word_lc"), *[v.alias(k) for k, v in typed.items()], "doc_id",
        F.when(positional, F.col("positions")).alias("positions"), F.when(positional, F.size("positions")).otherwise(1).alias("tf"),
    )


def _plain(word: Column, schema: ContextSchema) -> Column:
    """The word without zero fill, from which typed keys are read."""
    from termloom.functions.normalize import zero_fill_value

    return F.coalesce(zero_fill_value(word), word) if "ZeroFill" in schema.normalizers else word


def without_words(numbered: DataFrame, boring: Callable[[Column], Column] | list[str]) -> DataFrame:
    """``tokens`` without boring words, by list or predicate; the numbers of the others stay."""
    drop = F.lower("word").isin(boring) if isinstance(boring, list) else boring(F.col("word"))
    return numbered.where(~drop)


def mapped(posts: DataFrame, positions: Callable[[Column], Column]) -> DataFrame:
    """Postings with ``positions`` in place of theirs; where these are null or none are left, the posting goes."""
    new = positions(F.col("positions"))
    return posts.withColumn("positions", new).where(F.size("positions") > 0).withColumn("tf", F.size("positions"))


def vocabulary(posts: DataFrame) -> DataFrame:
    """context, word, word_lc, df."""
    return posts.groupBy("context", "word", "word_lc").agg(F.count("*").alias("df"))
