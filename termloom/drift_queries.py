"""Queries about drifting schemas over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import schema_drift as sd
from termloom.runtime import checkpointed, read_table, shared_path, spread, written


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source (table and feed), file_no, key and entries of both tables."""
    records = spread(read_table(spark, sf_dir, "api_documents").select("record_id", "feed", "batch_no", "ad_descr"))
    descriptions = spread(read_table(spark, sf_dir, "doc_descs").select("desc_id", "feed", "file_no", "un_desc"))
    row = lambda tab, file_no, key, entries: [F.struct(F.lit(tab).alias("tab"), "feed").alias("source"), F.col(file_no).alias("file_no"), F.col(key).alias("key"), entries.alias("entries")]
    parts = records.select(*row("api_documents", "batch_no", "record_id", sd.entries_of_fragments(F.col("ad_descr"))))
    return parts.unionByName(descriptions.select(*row("doc_descs", "file_no", "desc_id", sd.entries_of_json(F.col("un_desc")))))


def _ingested(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The schemas of the files, and the rows ingested each against the former file's."""
    schemas = checkpointed(sd.file_schemas(rows, "source", "file_no", F.col("entries")))
    return schemas, sd.ingest_files(rows, "source", "file_no", F.col("entries"), schemas)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ingested = _ingested(_rows(spark, sf_dir))
    return sd.changes(ingested).select("feed.tab", "feed.feed", "file_no", "change", "field_name", "new_name")


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables with one set of typed fields. The rows are ingested against the fields of the feeds' first files; the
    fields and names that the report finds later are approved, and what was rescued of them is replayed into their
    columns. What fits none stays in ``rescued``."""
    rows = _rows(spark, sf_dir)
    schemas, ingested = _ingested(rows)
    target, aliases = sd.target_schema(schemas, checkpointed(sd.changes(ingested)))
    first = {r[0] for r in schemas.where("seq = 1").select(F.explode(F.map_keys("own"))).distinct().collect()}
    early = {a: n for a, n in aliases.items() if a in first}
    ingest = sd.RescueIngest({n: t for n, t in target.items() if n in early.values()}, early)
    keyed = rows.select("source.tab", "source.feed", "file_no", "key", F.col("entries").alias("_source"))
    table = written(ingest.ingest(keyed, ["tab", "feed", "file_no", "key"], F.col("_source")), shared_path(spark, "ingested"))
    late = {a: n for a, n in aliases.items() if a not in first}
    return ingest.replay(table, {n: t for n, t in target.items() if n not in ingest.target}, late)


def p5_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that are not null, of each file, as the ingested table holds them in columns and in the rescue column."""
    table = p5_table(spark, sf_dir)
    typed = [F.col(f"`{c}`").isNotNull().cast("long") for c in table.columns if c not in ("tab", "feed", "file_no", "key", "rescued")]
    held = reduce(lambda a, b: a + b, [*typed, F.coalesce(F.size("rescued"), F.lit(0)).cast("long")])
    return table.groupBy("tab", "feed", "file_no").agg(F.sum(held).alias("entries"))


QUERIES = {"p5_found": p5_found, "p5_table": p5_table, "p5_entries": p5_entries}
SQL: dict[str, str] = {
    "p5_entries": """with d as (select 'doc_descs' as tab, feed, file_no, case when json_valid(un_desc) and json_type(un_desc) = 'OBJECT' then un_desc::json end as j from doc_descs),
k as (select tab, feed, file_no, len(list_filter(json_keys(j), lambda x: json_type(j, '$."' || x || '"') <> 'NULL')) as n from d),
a as (select 'api_documents' as tab, feed, batch_no as file_no, len(list_filter(map_values(ad_descr), lambda v: v is not null and trim(v) <> 'null')) as n from api_documents)
select tab, feed, file_no, coalesce(sum(n), 0)::bigint as entries from (select * from k union all select * from a) group by all""",
}
