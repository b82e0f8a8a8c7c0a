"""Documents of a result: lookup, ranking, paging, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_documents(scored: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, uri, description, weight, score; the score times the document's weight."""
    joined = docs.select("doc_id", "uri", "description", "weight").join(scored, "doc_id")
    return joined.withColumn("score", F.col("score") * F.col("weight"))


def weighted(scored: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, uri, weight, score: what ranking needs, without the descriptions."""
    joined = docs.select("doc_id", "uri", "weight").join(scored, "doc_id")
    return joined.withColumn("score", F.col("score") * F.col("weight"))


#: Pages of at most so many rows are sent to the documents rather than the documents to them.
BROADCAST_PAGE = 10_000


def described_page(hits: DataFrame, docs: DataFrame, offset: int = 0, most: int = -1) -> DataFrame:
    """A page of ``weighted`` hits with the descriptions of its documents only."""
    top = page(hits, offset, most)
    top = F.broadcast(top) if 0 <= most <= BROADCAST_PAGE else top
    return ranked(docs.select("doc_id", "description").join(top, "doc_id").select("doc_id", "uri", "description", "weight", "score"))


def ranked(results: DataFrame) -> DataFrame:
    """Highest score first, then by URI (and id, where URIs repeat)."""
    return results.orderBy(F.desc("score"), "uri", "doc_id")


def page(results: DataFrame, offset: int = 0, most: int = -1) -> DataFrame:
    """``most`` < 0: all from the offset on. Plans as one top-k over the partitions' top-ks."""
    out = ranked(results)
    if offset:
        out = out.offset(offset)
    return out.limit(most) if most >= 0 else out


def top_words(words: DataFrame, most: int) -> DataFrame:
    out = words.orderBy(F.desc("score"), "word")
    return out.limit(most) if most >= 0 else out


def projected(results: DataFrame, fields: list[str] | None = None, weight: bool = False) -> DataFrame:
    """Only the listed description fields, and a weight of 1 unless it is asked for."""
    if fields is not None:
        results = results.withColumn("description", restrict("description", fields))
    return results if weight else results.withColumn("weight", F.lit(1.0))


def result_statistics(hits: DataFrame) -> DataFrame:
    """Documents, words and their highest scores of raw hits (words, doc_id, score)."""
    return hits.agg(F.count_distinct("doc_id").alias("doc_hits"), F.count_distinct("words").alias("word_hits"), F.max("score").alias("max_score"))


def result_statistics_by_kind(hits: DataFrame) -> DataFrame:
    """Documents, words, and the highest score of a document (its hits' scores added up) and of a single hit."""
    per_doc = hits.groupBy("doc_id").agg(F.sum("score").alias("total"))
    docs = per_doc.agg(F.count("*").alias("doc_hits"), F.max("total").alias("max_doc_score"))
    return docs.crossJoin(hits.agg(F.count_distinct("words").alias("word_hits"), F.max("score").alias("max_word_score")))  # two rows of one


# Description operations on MAP<field, JSON fragment> columns.


def description_size(description: str | Column) -> Column:
    return F.coalesce(F.size(description), F.lit(0))


def description_list(description: str | Column) -> Column:
    """(field, value) pairs in the order of fields."""
    return F.array_sort(F.map_entries(description))


def description_of(pairs: Column) -> Column:
    """From (field, value) pairs; of a repeated field the last holds."""
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return delete_null(F.map_from_entries(last))


def restrict(description: str | Column, fields: list[str]) -> Column:
    return F.map_filter(description, lambda k, _: k.isin(fields)) if fields else F.map_filter(description, lambda k, _: F.lit(False))


def merge(old: str | Column, new: str | Column) -> Column:
    """New fields win, null ones remove."""
    old, new = (F.col(x) if isinstance(x, str) else x for x in (old, new))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return delete_null(F.map_concat(kept, new))


def delete_null(description: str | Column) -> Column:
    return F.map_filter(description, lambda _, v: v.isNotNull() & (F.trim(v) != "null"))


def delete_field(description: str | Column, name: str) -> Column:
    return F.map_filter(description, lambda k, _: k != name)


def insert_field(description: Column, name: str, value: Column) -> Column:
    return F.map_concat(delete_field(description, name), F.create_map(F.lit(name), value))


def lookup_field(description: str | Column, name: str) -> Column:
    return F.try_element_at(F.col(description) if isinstance(description, str) else description, F.lit(name))


def lookup_text(description: str | Column, name: str) -> Column:
    """A field as text: JSON strings without quotes, '' if absent."""
    value = lookup_field(description, name)
    return F.coalesce(F.when(F.trim(value).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]).otherwise(value), F.lit(""))
