"""Queries of this package over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.distinctiveness import distinctive_terms, query_words
from termloom.llm.leakage import leaked, reparameterised, template_matches
from termloom.llm.linkage import LinkStore
from termloom.llm.lookalikes import canonical_texts, lookalike_classes, lookalike_pairs
from termloom.llm.main_content import PathRatios, pages_of
from termloom.llm.packing import fill_report, kept_rules, pack, token_counts
from termloom.llm.reading_level import ReadingLevel
from termloom.llm.terms import TermStatistics
from termloom.runtime import checkpointed, shared_path, spread, written
from termloom.runtime import read_table as stored_table


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = stored_table(spark, sf_dir, name)
    return spread(table) if name == "documents" else table


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id and content of the records that have a content entry."""
    docs = read_table(spark, sf_dir, "api_documents").where(F.map_contains_key("ad_index", F.lit("content")))
    return spread(docs.select("record_id", F.col("ad_index")["content"].alias("content")))


def _linked(spark: SparkSession, sf_dir: str, reopened: bool) -> DataFrame:
    records = read_table(spark, sf_dir, "api_documents").select("record_id", "batch_no", "ad_uri")
    store = LinkStore(spark)
    store.load_history(records.where("batch_no = 0"), "record_id", "ad_uri")
    repeats = None
    for n in sorted(r[0] for r in records.where("batch_no > 0").select("batch_no").distinct().collect()):
        store = LinkStore(spark, store.path) if reopened else store
        found = store.accept(records.where(F.col("batch_no") == n), "record_id", "ad_uri")
        repeats = found if repeats is None else repeats.unionByName(found)
    return repeats if repeats is not None else spark.createDataFrame([], "first_id long, record_id long")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir, reopened=False)


def p1_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the store opened anew for every batch."""
    return _linked(spark, sf_dir, reopened=True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TermStatistics(contents(spark, sf_dir), "content").verdicts().where("verdict is not null").select("term", "verdict")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TermStatistics(contents(spark, sf_dir), "content").verdicts()


def _short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = read_table(spark, sf_dir, "api_documents").select(
        F.lit("api_documents").alias("tab"), F.col("record_id").alias("key"), F.col("ad_index")["subject"].alias("text")
    )
    asked = read_table(spark, sf_dir, "commands").where("cmd = 'search'")
    return subjects.unionByName(asked.select(F.lit("commands").alias("tab"), F.col("cmd_id").alias("key"), F.col("ic_query").alias("text")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(_short_texts(spark, sf_dir), "tab", "key", "text").distinct()


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _short_texts(spark, sf_dir).where("text is not null")
    return rows.join(canonical_texts(rows), "text", "left").select("tab", "key", F.coalesce("canonical", "text").alias("canonical"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_classes(_short_texts(spark, sf_dir), "tab", "key", "text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(pages_of(read_table(spark, sf_dir, "api_documents"), "record_id", "ad_uri", "ad_index['content']", "ad_index['subject']"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return PathRatios(pages).extract(pages, with_text=False).select("record_id", "line_no")


def p4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with the lines of its main body only."""
    pages = _pages(spark, sf_dir)
    lines = PathRatios(pages).extract(pages).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    return lines.select("record_id", F.array_join(F.transform("lines", lambda s: s["line"]), "\n").alias("content"))


def weighted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read_table(spark, sf_dir, "commands").where("cmd = 'search' and ic_weight")
    return asked.select(F.explode(query_words(F.col("ic_query"))).alias("term")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distinctive_terms(
        contents(spark, sf_dir), "record_id", "content", min_tf=3, max_share=1 / 50, wanted=weighted_words(spark, sf_dir)
    )
    return found.select("record_id", "term").distinct()


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = distinctive_terms(contents(spark, sf_dir), "record_id", "content")
    return scored.withColumn("score", F.round("score", 6))


def _leak_matches(spark: SparkSession, sf_dir: str, any_name: bool = False) -> DataFrame:
    return template_matches(read_table(spark, sf_dir, "documents"), "doc_id", "text", read_table(spark, sf_dir, "benchmark"), "item_id", "text", any_name=any_name)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(_leak_matches(spark, sf_dir), "doc_id", "item_id")


def p8_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reparameterised(checkpointed(_leak_matches(spark, sf_dir, any_name=True)), "doc_id", "item_id")


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack(counts, "doc_id", "n_tokens", read_table(spark, sf_dir, "containers"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p7_packing(spark, sf_dir))


def p7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in every kind of container, and whether the rules of packing hold there."""
    packed = written(p7_packing(spark, sf_dir), shared_path(spark, "packing"))
    return kept_rules(packed, "doc_id", read_table(spark, sf_dir, "containers"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where("lang = 'en'")
    model = ReadingLevel.fit(docs, "doc_id", "text", read_table(spark, sf_dir, "labels"), "doc_id", "grade")
    return model.predict(docs.where("n_cues >= 12"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_reopened": p1_reopened,
    "p2_found": p2_found,
    "p2_terms": p2_terms,
    "p3_found": p3_found,
    "p3_canonical": p3_canonical,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p4_pages": p4_pages,
    "p6_found": p6_found,
    "p6_scores": p6_scores,
    "p7_packing": p7_packing,
    "p7_fill": p7_fill,
    "p7_rules": p7_rules,
    "p8_found": p8_found,
    "p8_reparameterised": p8_reparameterised,
    "p9_found": p9_found,
}

_TERMS = """
with c as (select record_id, ad_index['content'] as content from api_documents where list_contains(map_keys(ad_index), 'content')),
n as (select count(*) as n from c),
t as (select record_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) as term from c),
v as (select term, count(*) as occurrences, count(distinct record_id) as records from t group by term),
w as (select v.*, case when records <= 2 then 'rare' when records * 100 >= 55 * n then 'common' end as verdict from v, n)
"""
_SCORES = _TERMS + """,
l as (select record_id, count(*) as len from t group by record_id),
a as (select (select count(*) from t)::double / (select n from n) as mean_len),
f as (select record_id, term, count(*) as tf from t group by record_id, term),
s as (select f.record_id, f.term, f.tf, v.records, f.tf * log2(1 + mean_len / len) as tfn, v.occurrences::double / n.n as m
      from f join v using (term) join l using (record_id), a, n)
"""

SQL: dict[str, str] = {
    "p7_rules": "select container_kind, doc_id, true as kept from containers, documents",
    "p2_found": _TERMS + "select term, verdict from w where verdict is not null",
    "p2_terms": _TERMS + "select term, occurrences, records, verdict from w",
    "p6_scores": _SCORES + "select record_id, term, tf, records, round((log2(1 + m) + tfn * log2((1 + m) / m)) / (tfn + 1), 6) as score from s",
    "p6_found": _TERMS + """,
q as (select distinct unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(ic_query,
    '\\^\\s*\\d+(\\.\\d+)?', ' ', 'g'), '([\\p{L}\\p{N}_]+\\s*,\\s*)*[\\p{L}\\p{N}_]+\\s*:', ' ', 'g'),
    '\\b(AND|OR|NOT|TO|(NEAR|FOLLOW)(\\s*\\d+)?)\\b', ' ', 'g')), '[\\p{L}\\p{N}]+')) as term
    from commands where cmd = 'search' and ic_weight),
f as (select record_id, term, count(*) as tf from t group by record_id, term)
select f.record_id, f.term from f join v using (term), n where tf >= 3 and v.records <= n.n / 50.0 and term in (select term from q)""",
}
