import json

import pytest
from pyspark.sql import functions as F

from termloom.operators import schema_drift as sd


@pytest.fixture(scope="module")
def files(spark):
    rows = []
    for i in range(40):
        rows.append(("f", 0, i, json.dumps({"size": 20000 + i, "legs": i % 5, "name": f"n{i % 3}", "old": "x", "odd": [i]})))
        late = {"size": 1} if i < 2 else {}
        rows.append(("f", 2, 100 + i, json.dumps({"bytes": 21000 + i, "legs": str(i % 5), "name": None if i % 2 else f"n{i % 3}", "odd": [i], "add": True} | late)))
    rows += [("g", 0, 900, '{"a": 1}'), ("g", 1, 901, "broken"), ("g", 1, 902, None), (None, 0, 903, '{"a": 1}')]
    return spark.createDataFrame(rows, "feed string, file_no int, key int, js string").withColumn("field", F.lit("clash"))


def report(df):
    entries = sd.entries_of_json(F.col("js"))
    schemas = sd.file_schemas(df, "feed", "file_no", entries)
    return sd.changes(sd.ingest_files(df, "feed", "file_no", entries, schemas))


def test_changes(files):
    got = {tuple(r) for r in report(files).collect()}
    want = {("renamed", "size", "bytes"), ("removed", "old", ""), ("added", "add", ""), ("retyped", "legs", "")}
    assert got == {("f", 2, *c) for c in want} | {("g", 1, "removed", "a", "")}
    # Feeds and files without a name are feeds and files.
    nameless = {tuple(r) for r in report(files.withColumn("feed", F.when(F.col("feed") != "f", F.col("feed"))).where("coalesce(feed, '') <> 'g' and key < 900")).collect()}
    assert nameless == {(None, 2, *c) for c in want}
    first = files.where("feed = 'f'").withColumn("file_no", F.when(F.col("file_no") > 0, F.col("file_no")))
    assert {tuple(r) for r in report(first).collect()} == {("f", 2, *c) for c in want}


def test_the_report_is_made_of_rescued_entries(files):
    entries = sd.entries_of_json(F.col("js"))
    schemas = sd.file_schemas(files, "feed", "file_no", entries)
    ingested = sd.ingest_files(files, "feed", "file_no", entries, schemas)
    seen = {r[0] for r in ingested.where("feed = 'f' and file_no = 2").select(F.explode(F.map_keys("rescued"))).distinct().collect()}
    assert seen == {"bytes", "legs", "add"}
    without = ingested.withColumn("rescued", F.map_filter("rescued", lambda k, v: F.lit(False)))
    assert {r["change"] for r in sd.changes(without).collect()} == {"removed"}


def _renames(spark, n, old, new):
    rows = [("f", file, i, json.dumps({f"{k}{file}": v(i) for k, v in values.items()})) for file, values in enumerate((old, new)) for i in range(n)]
    df = spark.createDataFrame(rows, "feed string, file_no int, key int, js string")
    changed = report(df)
    return {(r["field_name"][:-1], r["new_name"][:-1]) for r in changed.where("change = 'renamed'").collect()}


@pytest.mark.parametrize("n", [55, 4000])
def test_renames_do_not_depend_on_the_number_of_rows(spark, n):
    import random

    rng = random.Random(n)
    pool = lambda c: [c + a + b for a in "aeiou" for b in "klmnp"]
    some = lambda words: (lambda _: ", ".join(rng.sample(words, 3)))
    fresh = lambda form: (lambda _: "".join(rng.choice({"a": "bcdfghjklmnp", "A": "BCDFGHJKLMNP"}.get(c, c)) for c in form))
    tags, moods = some(pool("t")), some(pool("m"))
    assert _renames(spark, n, {"tags": tags}, {"label": tags}) == {("tags", "label")}
    assert _renames(spark, n, {"tags": lambda i: tags(i).split(", ")}, {"label": lambda i: tags(i).split(", ")}) == {("tags", "label")}
    assert _renames(spark, n, {"tags": tags}, {"mood": moods}) == set()
    assert _renames(spark, n, {"tags": lambda i: {"text": tags(i)}}, {"mood": lambda i: {"text": moods(i)}}) == set()
    # Words that never repeat are told by their character classes.
    assert _renames(spark, n, {"id": fresh("aaaaaaaa/Aaaaaaaa")}, {"key": fresh("aaaaaaaa/Aaaaaaaa")}) == {("id", "key")}
    assert _renames(spark, n, {"id": fresh("aaaaaaaa/Aaaaaaaa")}, {"key": fresh("aaaaaaaaaa aaaaaaaaaa")}) == set()


def test_types(spark):
    values = {"1": "integer", "1.0": "decimal", "1e3": "decimal", '"1"': "text", "true": "boolean", "[1]": "list", "{}": "object", "null": None}
    rows = spark.createDataFrame([(k,) for k in values], "j string").select("j", sd.value_type(F.parse_json("j")).alias("t")).collect()
    assert {r["j"]: r["t"] for r in rows} == values


def test_empty(files):
    assert report(files.where("false")).count() == 0


def test_rescue_and_replay(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x", "new": {"k": [1]}}'), (2, '{"A2": 2, "a": "no"}'), (3, None), (4, '{"a": 12, "b": 5}')], "key int, js string")
    ingest = sd.RescueIngest({"a": "integer", "b": "text"}, {"A2": "a"})
    table = ingest.ingest(df, ["key"], sd.entries_of_json(F.col("js")))
    got = {r["key"]: (r["a"], r["b"], r["rescued"]) for r in table.collect()}
    assert got == {1: (1, "x", {"new": '{"k":[1]}'}), 2: (2, None, {"a": '"no"'}), 3: (None, None, None), 4: (12, None, {"b": "5"})}
    again = ingest.replay(table, {"new": "object"})
    assert {r["key"]: (r["new"], r["rescued"]) for r in again.collect()} == {1: ('{"k":[1]}', None), 2: (None, {"a": '"no"'}), 3: (None, None), 4: (None, {"b": "5"})}
    schemas = sd.file_schemas(df.withColumn("feed", F.lit("f")).withColumn("n", F.lit(0)), "feed", "n", sd.entries_of_json(F.col("js")))
    target, aliases = sd.target_schema(schemas, spark.createDataFrame([("f", 1, "renamed", "A2", "a")], "feed string, file_no int, change string, field_name string, new_name string"))
    assert target["a"] == "integer" and aliases["A2"] == "a"


def test_replay_gives_what_direct_ingestion_gives(spark):
    """Fields and names approved later, one of them another name of a column that is there."""
    values = ['{"a": 1, "b": "x"}', '{"A2": 2, "c": true}', '{"a": null, "A2": "7", "c": "no", "d": [1]}', '{"a": 3, "A2": 4, "d": {}}', "[]", None, '{"c": "maybe", "z": 1.5}']
    df = spark.createDataFrame(list(enumerate(values)), "key int, js string")
    entries = sd.entries_of_json(F.col("js"))
    target, aliases = {"a": "integer", "b": "text", "c": "boolean", "d": "list"}, {"A2": "a"}
    direct = sd.RescueIngest(target, aliases).ingest(df, ["key"], entries)
    early = sd.RescueIngest({"a": "integer", "b": "text"})
    table = early.ingest(df, ["key"], entries)
    late = early.replay(table, {"c": "boolean", "d": "list"}, aliases)
    rows = lambda d: sorted((r["key"], r["a"], r["b"], r["c"], r["d"], sorted((r["rescued"] or {}).items())) for r in d.collect())
    assert str(rows(late)) == str(rows(direct)) and early.target == target
    assert rows(direct)[2][1:5] == (7, None, False, "[1]") and rows(direct)[3][1] == 3 and dict(rows(direct)[3][5]) == {"A2": "4", "d": "{}"}
