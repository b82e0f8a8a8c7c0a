import json

import pytest
from pyspark.sql import functions as F

from termloom.operators.context_types import ContextSchema
from termloom.operators.engine import Engine, batched
from termloom.plans import query as Q
from termloom.plans.compiler import ProcessConfig, QueryError
from termloom.plans.parser import parse
from termloom.sources import documents as D
from termloom.sources.store import GenerationStore

SCHEMAS = {
    "title": ContextSchema(),
    "body": ContextSchema(weight=0.5),
    "tag": ContextSchema("text-small", default=False),
    "up": ContextSchema(normalizers=("UpperCase",), default=False),
    "num": ContextSchema("int", default=False),
    "day": ContextSchema("date", default=False),
    "geo": ContextSchema("position", default=False),
    "rect": ContextSchema("position-rtree", default=False),
}
DOCS = [
    {"uri": "t://1", "index": {"title": "Brain waves", "body": "the brain and the mind", "tag": "x y", "num": "5 -7", "day": "2013-01-01", "geo": "53.60000-10.00000", "rect": "53.6-10.0", "up": "Brain"}, "description": {"name": '"A"', "legs": "4"}},
    {"uri": "t://2", "index": {"title": "Mind maps", "body": "a mind maps the brain the mind"}, "description": {"name": '"B"'}, "weight": 2.0},
    {"uri": "t://3", "index": {"title": "brainy", "num": "-3", "day": "2012-12-31"}},
    {"uri": "t://4", "index": {"title": "wave of brain"}, "description": {"gone": "null"}, "weight": -1.0},
]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, SCHEMAS)
    e.insert(DOCS)
    e.docs, e.postings = e.docs.coalesce(1).cache(), e.postings.coalesce(1).cache()
    return e


def hits(e, q, **k):
    return {r["uri"]: round(r["score"], 4) for r in e.search(q, **k).collect()}


def uris(e, q):
    return sorted(r["uri"] for r in e.select(q).collect())


def test_words(engine):
    # 0.75 same length in other case; title weight 1, body weight 0.5, best context counts, document weight multiplies
    assert hits(engine, "brain") == {"t://1": 0.75, "t://2": 1.0, "t://4": 1.0, "t://3": round(0.5 * 5 / 6, 4)}
    assert uris(engine, '"brain"') == ["t://1", "t://2", "t://4"]
    assert uris(engine, "!Bra") == ["t://1"]
    assert uris(engine, "!bra") == ["t://1", "t://2", "t://3", "t://4"]
    assert uris(engine, "~BRAIN") == uris(engine, "brain")
    assert uris(engine, "up:brain") == ["t://1"] and uris(engine, "up:!BRA") == ["t://1"]


def test_score_algebra(engine):
    # 'mind' occurs twice in body of 2: 0.5 * 2 = 1 = title; weight 2
    assert hits(engine, '"mind"')["t://2"] == 2.0
    both = hits(engine, "brain mind")
    assert both == {"t://1": 0.75 + 0.5, "t://2": 2 * (0.5 + 1.0)}
    assert hits(engine, "brain^3 AND NOT mind") == {"t://4": 3.0, "t://3": round(3 * 0.5 * 5 / 6, 4)}
    assert hits(engine, "title:(waves OR maps)") == {"t://1": 1.0, "t://2": 2.0}


def test_positional(engine):
    assert uris(engine, '"the mind"') == ["t://1", "t://2"]
    assert uris(engine, '"brain the mind"') == ["t://2"]
    assert uris(engine, "brain FOLLOW 2 mind") == ["t://2"]
    assert uris(engine, "brain FOLLOW 3 mind") == ["t://1", "t://2"]
    assert uris(engine, "mind NEAR 3 brain") == ["t://1", "t://2"]
    assert uris(engine, "bra ++ wav") == ["t://1"]
    assert uris(engine, "tag:(x ++ y)") == ["t://1"]
    # sum of similarities times the surviving positions, boost is a lower bound in phrases
    assert hits(engine, '"the mind"')["t://1"] == 0.5 * 2
    assert hits(engine, Q.nexts([Q.Boost(3.0, Q.FullWord("the")), Q.FullWord("mind")]))["t://1"] == 0.5 * 4


def test_typed(engine):
    assert uris(engine, "num:[-10 TO -5]") == ["t://1"]
    assert uris(engine, "num:[-4 TO 5]") == ["t://1", "t://3"]
    assert uris(engine, "num:5") == ["t://1"] and uris(engine, "num:x") == []
    assert uris(engine, "day:[2012 TO 2012-12-31]") == ["t://3"] and uris(engine, "day:2013-01") == ["t://1"]
    assert uris(engine, "geo:[1-1 TO 80-80]") == ["t://1"]
    assert uris(engine, "geo:[-80--80 TO 1-1]") == [] and uris(engine, "geo:[60--80 TO 70--80]") == []
    assert uris(engine, "geo:[80-80 TO 1-1]") == [] and uris(engine, "rect:[80-80 TO 1-1]") == ["t://1"]
    assert uris(engine, "title:[maps TO wave]") == ["t://2", "t://4"]


def test_pages(engine):
    page = engine.search("brain", 1, 2)
    assert [r["uri"] for r in page.collect()] == ["t://4", "t://1"]
    assert engine.count("brain") == 4
    row = engine.search("waves", fields=["legs"]).first()
    assert row["description"] == {"legs": "4"} and row["weight"] == 1.0
    assert engine.search('"maps"', weight=True).first()["weight"] == 2.0


def test_limit_of_documents(spark, engine):
    e = Engine(spark, SCHEMAS, ProcessConfig(doc_limit=1))
    e.docs, e.postings = engine.docs, engine.postings
    # words in index order (short first) until a document is reached, in each context
    assert uris(engine, "title:bra") == ["t://1", "t://3", "t://4"]
    assert sorted(hits(e, "title:bra")) == ["t://1"]


def test_completion(engine):
    words = {r["word"]: r["score"] for r in engine.completion("bra").collect()}
    assert set(words) == {"Brain", "brain", "brainy"}
    assert [r["word"] for r in engine.completion("waves AND ma").collect()] == []
    assert [r["word"] for r in engine.completion("mind AND ma").collect()] == ["maps"]
    assert [r["word"] for r in engine.completion(Q.Phrase("the mi")).collect()] == ["mind"]
    assert [r["word"] for r in engine.completion("x OR wav", 1).collect()] == ["wave"]


def test_unknown_context(engine):
    with pytest.raises(QueryError) as e:
        engine.search("nope:a")
    assert e.value.code == 404
    with pytest.raises(QueryError) as e:
        engine.search("(")
    assert e.value.code == 400


def test_commands(spark, tmp_path):
    e = Engine(spark)
    e.execute([{"cmd": "insert-context", "context": "c", "schema": {"type": "text"}}, {"cmd": "insert", "document": {"uri": "u:1", "index": {"c": "one two"}, "description": {"a": 1, "b": "x"}}}, {"cmd": "insert", "document": {"uri": "u:2", "index": {"c": "two"}}}])
    for bad, code in [
        ({"cmd": "insert", "document": {"uri": "u:1", "index": {"c": "x"}}}, 409),
        ({"cmd": "insert", "document": {"uri": "u:9", "index": {"zz": "x"}}}, 409),
        ({"cmd": "insert", "document": [{"uri": "u:9"}, {"uri": "u:9"}]}, 409),
        ({"cmd": "update", "document": {"uri": "u:9"}}, 409),
        ({"cmd": "insert-context", "context": "c", "schema": {"type": "text"}}, 409),
        ({"cmd": "insert-context", "context": "d", "schema": {"type": "what"}}, 410),
        ({"cmd": "insert-context", "context": "d", "schema": {"type": "text", "normalizers": ["what"]}}, 410),
        ({"cmd": "what"}, 400),
    ]:
        with pytest.raises(QueryError) as err:
            e.execute(bad)
        assert err.value.code == code
    e.execute({"cmd": "update", "document": {"uri": "u:1", "index": {"c": "three"}, "description": {"a": None, "c": 3}, "weight": 2}})
    doc = e.lookup(["u:1"]).first()
    assert doc["description"] == {"b": '"x"', "c": "3"} and doc["weight"] == 2.0
    assert uris(e, "one") == ["u:1"] and uris(e, "three") == ["u:1"]
    found = e.execute({"cmd": "search", "query": "two", "max": 1})
    assert found["count"] == 2 and found["result"].count() == 1
    path = str(tmp_path / "ix")
    assert e.execute({"cmd": "store", "path": path}) == 1
    e.execute({"cmd": "delete-by-query", "query": "three"})
    assert uris(e, "two") == ["u:2"] and e.status("doctable").count() == 1
    assert e.store(path) == 2
    e.execute({"cmd": "load", "path": path})
    assert uris(e, "two") == ["u:2"]
    e.load(path, 1)
    assert uris(e, "two") == ["u:1", "u:2"]
    e.execute({"cmd": "delete", "uri": "u:1"})
    e.execute({"cmd": "delete", "uri": "u:unknown"})
    assert uris(e, "two") == ["u:2"]
    assert [r["word"] for r in e.status("context", "c").collect()] == ["two"]
    e.execute({"cmd": "delete-context", "context": "c"})
    e.execute({"cmd": "delete-context", "context": "c"})
    assert e.status("index").count() == 0 and e.execute({"cmd": "noop"}) is None
    with pytest.raises(QueryError) as err:
        e.load(str(tmp_path / "none"))
    assert err.value.code == 404
    with pytest.raises(QueryError) as err:
        GenerationStore(spark, path).write(e.docs, e.postings, e.schemas, parent=1)
    assert err.value.code == 409


def test_batching():
    insert = lambda n: {"cmd": "insert", "document": {"uri": n}}
    assert batched([insert("a"), insert("b"), {"cmd": "noop"}, {"cmd": "delete", "uri": "a"}, {"cmd": "delete", "uri": "b"}]) == [
        {"cmd": "insert", "document": [{"uri": "a"}, {"uri": "b"}]}, {"cmd": "noop"}, {"cmd": "delete", "uri": ["a", "b"]},
    ]


def test_json_source_round_trip(spark, tmp_path, engine):
    lines = ['{"uri":"u:1","index":{"c":"x"},"description":{"a":[1,{"b":null}],"s":"q"},"weight":0.5}', '{"uri":"u:2"}', "broken"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    read = D.read_json(spark, str(tmp_path / "in")).orderBy("uri")
    assert [r["uri"] for r in read.collect()] == ["u:1", "u:2"]
    assert json.loads(read.first()["description"]["a"]) == [1, {"b": None}]
    D.write_json(read, str(tmp_path / "out"))
    again = D.read_json(spark, str(tmp_path / "out")).orderBy("uri")
    assert again.first() == read.first()
    assert json.loads(D.to_json_lines(engine.docs.where("uri = 't://2'")).first()[0]) == {"uri": "t://2", "description": {"name": "B"}, "weight": 2.0}


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,size\n1,abc,\n2,,7\n")
    rows = D.read_csv(spark, str(tmp_path / "a.csv"), "id", ["name", "size"], ["name"]).orderBy("uri").collect()
    assert rows[0]["index"] == {"name": "abc"} and rows[0]["description"] == {"name": '"abc"'} and rows[1]["index"] == {"size": "7"}


def test_stream(spark, tmp_path):
    from termloom.streaming.ingest import stream_json

    (tmp_path / "s").mkdir()
    e = Engine(spark, {"c": ContextSchema()})
    (tmp_path / "s" / "1.json").write_text('{"uri":"u:1","index":{"c":"one"}}\n')
    stream_json(spark, e, str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "s" / "2.json").write_text('{"uri":"u:1","index":{"c":"two"}}\n{"uri":"u:2","index":{"c":"two"}}\n')
    stream_json(spark, e, str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    assert uris(e, "two") == ["u:1", "u:2"] and uris(e, "one") == ["u:1"]


def test_random_corpora_against_brute_force(spark):
    """Prefix AND/OR/phrase results of random small corpora against plain Python."""
    import random

    rng = random.Random(7)
    vocab = ["aa", "ab", "abc", "b", "ba", "Ab", "c"]
    docs = [{"uri": f"r:{i}", "index": {"title": " ".join(rng.choices(vocab, k=rng.randint(0, 8))), "body": " ".join(rng.choices(vocab, k=5))}} for i in range(40)]
    e = Engine(spark, {"title": ContextSchema(), "body": ContextSchema(weight=0.5)}, ProcessConfig(doc_limit=0))
    e.insert(docs)
    texts = {d["uri"]: d["index"] for d in docs}

    def sim(k, w):
        return 1.0 if k == w else 0.75 if len(k) == len(w) else 0.5 * len(k) / len(w) if len(w) > len(k) else 0.0

    def one(k):
        out = {}
        for u, ix in texts.items():
            for c, weight in (("title", 1.0), ("body", 0.5)):
                ws = ix[c].split()
                for w in set(ws):
                    if w.lower().startswith(k):
                        out[u] = max(out.get(u, 0.0), weight * sim(k, w) * ws.count(w))
        return out

    a, b = one("ab"), one("b")
    assert hits(e, "ab") == {u: round(s, 4) for u, s in a.items()}
    assert hits(e, "ab b") == {u: round(a[u] + b[u], 4) for u in a.keys() & b.keys()}
    assert hits(e, "ab OR b") == {u: round(max(a.get(u, 0), b.get(u, 0)), 4) for u in a.keys() | b.keys()}
    rows = {u for u, ix in texts.items() for c in ix for x, y in zip(ix[c].split(), ix[c].split()[1:]) if x.lower() == "ab" and y == "c"}
    assert set(uris(e, '"ab c"')) == rows
    assert set(parse('"ab c"').args) and e.docs.where(F.col("weight") != 1).count() == 0


def test_update_of_one_uri_several_times(spark):
    e = Engine(spark, SCHEMAS)
    e.insert([{"uri": "t://1", "index": {"title": "one"}, "description": {"a": "1", "b": "1", "c": "1"}}])
    batch = [
        {"uri": "t://1", "index": {"title": "two"}, "description": {"a": "2", "b": "null", "d": "2"}, "weight": 2.0},
        {"uri": "t://1", "index": {"title": "three"}, "description": {"a": "3", "d": "null"}},
        {"uri": "t://1", "description": {"b": "4"}, "weight": -1.0},
    ]
    e.update(batch)
    assert [(r["uri"], r["description"], r["weight"]) for r in e.docs.collect()] == [("t://1", {"a": "3", "b": "4", "c": "1"}, 2.0)]
    assert [uris(e, w) for w in ("one", "two", "three")] == [["t://1"]] * 3
    with pytest.raises(QueryError) as error:
        e.update(e._records(batch))
    assert error.value.code == 409
