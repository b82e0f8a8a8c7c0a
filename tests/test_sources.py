import pytest
from pyspark.sql import functions as F

from termloom.operators import analysis
from termloom.operators import occurrences as O
from termloom.operators.context_types import ContextSchema, ContextType, register_type
from termloom.operators.engine import Engine
from termloom.plans.parser import parse
from termloom.sources import commands as C
from termloom.sources.mapdata import read_nodes


def test_commands_round_trip():
    cs = C.sequence([C.insert_context("c", ContextSchema(weight=0.5)), C.insert(C.document("u:1", {"c": "x"})), C.search(parse("a b"), 1, 2, True, ["f"]), C.completion("a"), C.select("a"), C.update(C.document("u:1")), C.delete("u:1"), C.delete_by_query("x"), C.delete_context("c"), C.store("p"), C.load("p"), C.status("gc"), C.noop()])
    assert C.loads(C.dumps(cs)) == cs
    assert C.search("a") == {"cmd": "search", "query": "a", "offset": 0, "max": -1}
    with pytest.raises(ValueError):
        C.loads('[{"cmd": "what"}]')


def test_map_data(spark, tmp_path):
    (tmp_path / "m.xml").write_text("""<osm><node id="1" lat="53.6" lon="10.0"><tag k="name" v="Old &quot;Inn&quot;"/><tag k="amenity" v="pub"/></node>
<node id="2" lat="1" lon="2"><tag k="amenity" v="pub"/></node><node id="3" lat="1" lon="2"/><node id="4" lat="1" lon="2"><tag k="name" v="x"/><tag k="amenity" v="pub"/><tag k="power" v="y"/></node></osm>""")
    rows = read_nodes(spark, str(tmp_path / "m.xml"), ["amenity"], ("power",)).collect()
    assert len(rows) == 1 and rows[0]["uri"] == "osm://1"
    assert rows[0]["index"] == {"name": 'Old "Inn"', "kind": "amenity", "position": "53.60000-10.00000", "amenity": "pub"}


def test_occurrences(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, positions array<int>")
    a, b = frame([(1, [1, 2, 3]), (2, [4])]), frame([(1, [2, 9]), (3, [5])])
    as_dict = lambda d: {r["doc_id"]: r["positions"] for r in d.collect()}
    assert as_dict(O.merge(a, b)) == {1: [1, 2, 3, 9], 2: [4], 3: [5]}
    assert as_dict(O.difference(a, b)) == {2: [4]}
    assert as_dict(O.subtract(a, b)) == {1: [1, 3], 2: [4]}
    assert as_dict(O.intersect(a, b)) == {1: [2]}
    assert {r["doc_id"]: r["n"] for r in O.size(a).collect()} == {1: 3, 2: 1}


def test_own_type_and_boring_words(spark):
    register_type(ContextType("real", r"-?[0-9]+\.[0-9]+", lambda w: w.try_cast("double").isNotNull(), False, columns=lambda w: {"lat": w.try_cast("double")}, parse=lambda w: float(w), equals=lambda k: F.col("lat") == k, between=lambda x, y: F.col("lat").between(x, y)))
    e = Engine(spark, {"r": ContextSchema("real")})
    e.insert([{"uri": "u:1", "index": {"r": "1.50 -2.25"}}, {"uri": "u:2", "index": {"r": "9.0"}}])
    assert [r["uri"] for r in e.select("[-3 TO 0]").collect()] == ["u:1"] and [r["uri"] for r in e.select("1.5").collect()] == ["u:1"]
    docs = spark.createDataFrame([(1, {"t": "The cat the dog"})], "doc_id bigint, index map<string,string>")
    rows = analysis.postings(docs, {"t": ContextSchema()}, ["the"]).collect()
    assert {r["word"]: r["positions"] for r in rows} == {"cat": [2], "dog": [4]}
