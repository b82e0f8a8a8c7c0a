import pytest

from termloom.llm.leakage import WINDOW, Templates, leaked, reparameterised, template_matches
from termloom.llm.reading_level import ReadingLevel
from termloom.llm.subtitles import cues, skeleton, speech, tokens

SRT = """﻿1\r
00:00:02,000 --> 00:00:03,000\r
second <i>cue</i> [door\r
creaks] here\r
\r
2\r
00:00:01,000 --> 00:00:02,000\r
- BOB: First, café's (sighs) one\r
\r
00:00:05.000 --> 00:00:06.000\r
Get it at www.ads.example now\r
\r
9\r
00:00:07,000 --> 00:00:08,000\r
♪ la la ♪ {\\an8}last *thud* 42\r
"""


def test_cues_and_speech():
    assert len(cues(SRT)) == 4
    assert [w.lower() for w in tokens(speech(SRT))] == ["first", "cafs", "one", "second", "cue", "here", "last", "42"]
    assert tokens(speech(None)) == [] and speech("plain text") == "plain text" and speech("") == ""


@pytest.mark.parametrize(("read", "meant"), [("Thc", "the"), ("1nsofar", "insofar"), ("fhis", "this"), ("cl0cks", "clocks"), ("rnap", "map"), ("novv", "now"), ("yeilow", "yellow"), ("1O4", "104")])
def test_recognition_errors(read, meant):
    assert skeleton(read) == skeleton(meant)
    assert skeleton("104") != skeleton("105")


ITEM = "During the Zopa survey crews hauled 771 crates of hen wire past towers toward one frozen orchard in 12 days."


def srt(words, broken=4):
    lines = [" ".join(words[i : i + broken]) for i in range(0, len(words), broken)]
    return "".join(f"{n}\n00:00:{n:02d},000 --> 00:00:{n:02d},900\n{line}\n[thunder]\n\n" for n, line in enumerate(lines, 1))


def test_leakage(spark):
    words = ITEM.split()
    docs = {
        1: srt(["Hello", "there"] + words + ["bye"]),
        2: srt([w.upper() for w in words[3 : 3 + WINDOW]]),
        3: srt(words[3 : 2 + WINDOW]),
        4: srt(ITEM.replace("771", "905").replace("Zopa", "Keze").replace("12 days", "14 days").split()),
        5: srt([w.replace("e", "c").replace("o", "0") for w in words]),
        6: None,
        7: "",
        8: "word " * 20_000 + ITEM,
    }
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs.items()] + [(1, docs[1], "clash")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(70, ITEM, 0), (71, "too short", 0), (72, None, 0), (70, ITEM, 0)], "item_id bigint, text string, doc_id int")
    m = template_matches(df, "doc_id", "text", items, "item_id", "text").cache()
    assert sorted(tuple(r) for r in leaked(m, "doc_id", "item_id").collect()) == [(1, 70), (2, 70), (5, 70), (8, 70)]
    assert [tuple(r)[:2] for r in reparameterised(m, "doc_id", "item_id").collect()] == [(4, 70)]
    none = template_matches(df, "doc_id", "text", items.where("false"), "item_id", "text")
    assert none.count() == 0 and template_matches(df.where("false"), "doc_id", "text", items, "item_id", "text").count() == 0


def test_long_and_open_brackets():
    one = "00:00:01,000 --> 00:00:02,000\n"
    assert speech(one + "a [" + "x" * 5000 + "] b").split() == ["a", "b"]
    assert speech(one + "a (one\n\n" + one + "two) b\n\n" + one + "c <i d\n\n" + one + "e\n\n" + one + "f> g").split() == "a b c <i d e f> g".split()


def test_the_filter_only_saves_work(spark, monkeypatch):
    from termloom.llm import leakage

    items = spark.createDataFrame([(n, ITEM.replace("771", str(100 + n))) for n in range(7)], "item_id bigint, text string")
    docs = spark.createDataFrame([(n, ITEM.replace("771", str(100 + n))) for n in range(9)], "doc_id bigint, text string")
    found = lambda: sorted(map(str, template_matches(docs, "doc_id", "text", items, "item_id", "text", any_name=True).collect()))
    whole = found()
    assert {(n, n) for n in range(7)} <= set(map(tuple, leaked(template_matches(docs, "doc_id", "text", items, "item_id", "text"), "doc_id", "item_id").collect()))
    monkeypatch.setattr(leakage, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(leakage, "_bitmap", lambda w: leakage.np.full(1 << 13, 255, leakage.np.uint8))
    assert found() == whole


def test_windows_of_slots_only_match_by_their_words(spark):
    """Tables of numbers share one template; only equal ones meet."""
    row = lambda k: " ".join(str(k * 31 + i) for i in range(14))
    items = spark.createDataFrame([(k, "Kept: " + row(k)) for k in range(5)], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, "speech " + row(k)) for k in range(3, 60)], "doc_id bigint, text string")
    m = template_matches(docs, "doc_id", "text", items, "item_id", "text")
    assert {(r["doc_id"], r["item_id"]) for r in m.collect()} == {(3, 3), (4, 4)}
    assert {tuple(r) for r in leaked(m, "doc_id", "item_id").collect()} == {(3, 3), (4, 4)}


def test_recall_of_reparameterised_items(spark):
    """Every item of the test data with its numbers and names replaced, each by one and the same, inside other speech."""
    import re

    texts = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()
    swap = lambda m: str(int(m[0]) + 7) if m[0].isdigit() else m[0][:1] + m[0][1:][::-1] + "ux"
    docs = []
    for r in texts:
        first, rest = r["text"][:1], r["text"][1:]
        docs.append((r["item_id"], "and so on we go " + first + re.sub(r"(?<=[a-z,] )[A-Z][a-z]+|\d+", swap, rest) + " that is all"))
    changed = {i for (i, t), r in zip(docs, texts) if r["text"] not in t}
    m = template_matches(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame(texts), "item_id", "text", any_name=True).cache()
    either = {tuple(r)[:2] for r in reparameterised(m, "doc_id", "item_id").collect()} | {tuple(r) for r in leaked(m, "doc_id", "item_id").collect()}
    assert len(changed) > 20 and sum((i, i) in either for i in changed) / len(changed) >= 0.95


def test_new_units_and_names_in_any_case(spark, monkeypatch):
    from termloom.llm import leakage

    item = "Near Zopa the crews hauled 82 miles of wire past Zopa toward one frozen orchard"
    texts = [item.replace("miles", "leagues"), item.replace("Zopa", "Keze").upper(), item.replace("Zopa", "Keze").lower(), item.replace("Zopa", "orchard")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(70, item), (71, "An orchard hauled by the Keze crews"), (72, "short")], "item_id bigint, text string")
    found = lambda: {tuple(r)[:2] for r in reparameterised(template_matches(docs, "doc_id", "text", items, "item_id", "text", any_name=True), "doc_id", "item_id").collect()}
    assert found() == {(n, 70) for n in range(4)}
    monkeypatch.setattr(leakage, "MOST_BITS", leakage.LEAST_BITS)
    assert found() == {(n, 70) for n in range(4)}


def test_slot_types():
    from termloom.llm.leakage import NAME, NUMBER, UNIT, _id

    t = Templates([ITEM])
    assert skeleton("Zopa") in t.names and skeleton("crates") in t.units
    kinds = {"771": NUMBER, "Zopa": NAME, "crates": UNIT, "survey": skeleton("survey"), "Unheard": NAME}
    assert all(t.token(w) == (_id(kind), _id(skeleton(w))) for w, kind in kinds.items())


def test_reading_level(spark):
    import random

    rng = random.Random(3)
    pools = {g: [f"{'abcd'[g - 1]}{'klmnprstuv'[i % 10]}{'aeiou'[i // 10]}w" for i in range(30)] for g in range(1, 5)}
    common = ["gnu", "puma", "yak"]
    text = lambda g: " ".join(rng.choice(pools[g] if rng.random() < 0.7 else pools[rng.randint(1, 4)] if rng.random() < 0.3 else common) for _ in range(120))
    truth = {i: rng.randint(1, 4) for i in range(300)}
    docs = spark.createDataFrame([(i, text(g), 0) for i, g in truth.items()] + [(900, None, 0), (901, "", 0), (902, "zzz qqq", 0)], "doc_id bigint, text string, grade int")
    labels = [(i, g if rng.random() < 0.9 else min(4, g + 1)) for i, g in truth.items() if i < 200] + [(5, None), (6, truth[6]), (6, truth[6]), (7777, 2)]
    graded = spark.createDataFrame(labels, "doc_id bigint, grade int")
    model = ReadingLevel.fit(docs, "doc_id", "text", graded, "doc_id", "grade")
    got = {r["doc_id"]: r["grade"] for r in model.predict(docs, "doc_id", "text").collect()}
    held_out = [i for i in truth if i >= 200]
    assert sum(got[i] == truth[i] for i in held_out) >= 0.95 * len(held_out)
    assert got[900] == got[901] == got[902] == model.usual
    unfitted = ReadingLevel.fit(docs, "doc_id", "text", graded.where("false"), "doc_id", "grade")
    assert {r["grade"] for r in unfitted.predict(docs, "doc_id", "text").collect()} == {None}
    assert model.predict(docs.where("false"), "doc_id", "text").count() == 0
