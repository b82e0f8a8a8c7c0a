import pytest

from termloom.llm.lookalikes import Trie, by_table, canonical_texts, lookalike_classes, lookalike_pairs

PLAIN = "Bar of Ünïque fíve"
ODD = ["Bаr оf Ünïque fíve", "Bar of Ünïque ﬁve".replace("ﬁve", "fíve"), "Ｂａｒ of Ünïque fíve", "Bar of Ünïque fíve", "B​ar⁠ of Ün­ïque fíve", "Bar of Ünïque fíve"]


def test_table():
    assert {by_table(t) for t in ODD} == {PLAIN}
    assert by_table("ﬁn") == "fin" and by_table("K") == "K" and by_table("a\tb　c") == "a b c"
    for a, b in [("Bar", "bar"), ("fíve", "five"), ("a  b", "a b"), ("a,b", "a.b"), ("x²", "x2")]:
        assert by_table(a) != by_table(b)


def test_trie():
    t = Trie()
    t.add("fíve", 3)
    t.add("five", 9)
    assert t.match("fívе") == "fíve" and t.match("ﬁve") == "five" and t.match("fiv") is None
    assert t.match("fivx", budget=1) == "five" and t.match("fivve", budget=1) == "five" and t.match("iv", budget=1) is None
    assert t.match("") is None and Trie().match("x") is None
    t.add("list", 4)
    t.add("100", 1)
    assert t.match("\u0406ist") == "list" and t.match("1\u041e\u041e") == "100" and t.match("1\u041e\u041e", budget=0) is None
    t.add("Iist", 1)
    assert t.match("\u0406ist") == "Iist"


def test_the_vocabulary_decides(spark):
    """A letter with two readings is read as the word of the collection that it makes; the table alone knows one."""
    texts = ["the list of 100", "the \u0406ist of 1\u041e\u041e", "\u0406n here", "In there", "a\ttab", "a tab", "no\u00a0w\u043erd", "\u0430\u0431\u0432"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["canonical"] for r in canonical_texts(df).collect()}
    assert got == {texts[1]: texts[0], texts[2]: "In here", texts[4]: texts[5], texts[6]: "no word", texts[7]: "a\u0431\u0432"}
    assert by_table(texts[1]) != texts[0]


def test_classes(spark):
    rows = [("g", 5, "same"), ("g", 3, "s\u0430me"), ("g", 9, "s\u0430me"), ("g", 4, "other"), ("h", 1, "same"), ("g", 2, None)]
    df = spark.createDataFrame(rows, "g string, k bigint, t string")
    got = sorted(tuple(r) for r in lookalike_classes(df, "g", "k", "t").collect())
    assert got == [("g", 3, 3, 2), ("g", 5, 3, 2), ("g", 9, 3, 2)]
    assert lookalike_classes(df.where("false"), "g", "k", "t").count() == 0


def test_pairs_against_brute_force(spark):
    texts = [*ODD, PLAIN, PLAIN, "other", "оther", "оthеr", None, "", " ", " ", "x" * 5000, "х" + "x" * 4999, "only ｏdd"]
    rows = [(g, i, t, "clash") for i, t in enumerate(texts) for g in ("a", "b")]
    df = spark.createDataFrame(rows, "grp string, id bigint, body string, text string")
    want = {(g, i, j) for g in "ab" for i, s in enumerate(texts) for j, t in enumerate(texts) if i < j and None not in (s, t) and s != t and by_table(s) == by_table(t)}
    got = [tuple(r) for r in lookalike_pairs(df, "grp", "id", "body").collect()]
    assert set(got) == want and len(got) == len(want)


def test_canonical_and_empty(spark):
    df = spark.createDataFrame([(t,) for t in [*ODD, None, "", PLAIN]], "text string")
    assert {r["canonical"] for r in canonical_texts(df).collect()} == {PLAIN}
    empty = df.where("false")
    assert canonical_texts(empty).count() == 0


@pytest.mark.parametrize("n", [1, 300])
def test_copies_are_not_paired_with_each_other(spark, n):
    df = spark.createDataFrame([("g", i, "same") for i in range(n)] + [("g", 1000, "sаme")], "g string, k bigint, t string")
    assert lookalike_pairs(df, "g", "k", "t").count() == n
