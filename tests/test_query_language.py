import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.plans import query as Q
from termloom.plans.parser import ParseError, parse

W = Q.Word
CASES = [
    ("a", W("a")),
    (" a ", W("a")),
    ("a b", Q.ands([W("a"), W("b")])),
    ("a AND b", Q.ands([W("a"), W("b")])),
    ("a OR b", Q.ors([W("a"), W("b")])),
    ("a OR b OR c", Q.ors([W("a"), W("b"), W("c")])),
    ("a AND b OR c", Q.ors([Q.ands([W("a"), W("b")]), W("c")])),
    ("a AND NOT b", Q.and_nots([W("a"), W("b")])),
    ("a AND NOT b AND NOT c", Q.and_nots([W("a"), W("b"), W("c")])),
    ("!a", W("a", Q.CASE)),
    ("~a", W("a", Q.FUZZY)),
    ('"a"', Q.FullWord("a")),
    ('"a b"', Q.nexts([Q.FullWord("a"), Q.FullWord("b")])),
    ('!"a b"', Q.nexts([Q.FullWord("a", Q.CASE), Q.FullWord("b", Q.CASE)])),
    ("'a b'", W("a b")),
    (r"a\ b", Q.nexts([W("a"), W("b")])),
    ("a ++ b", Q.nexts([W("a"), W("b")])),
    ("a NEAR 3 b", Q.nears(3, [W("a"), W("b")])),
    ("a FOLLOW 2 b", Q.follows(2, [W("a"), W("b")])),
    ("x:a", Q.in_contexts(["x"], W("a"))),
    ("x,y: a", Q.in_contexts(["x", "y"], W("a"))),
    ("x:(a b)", Q.in_contexts(["x"], Q.ands([W("a"), W("b")]))),
    ("a^2.5", Q.boosted(2.5, W("a"))),
    ("x:a^2", Q.boosted(2.0, Q.in_contexts(["x"], W("a")))),
    ("[1 TO 5]", Q.range_of("1", "5")),
    ("NOT", W("NOT")),
    ("ORANGE", W("ORANGE")),
    ("a b OR c", Q.ors([Q.ands([W("a"), W("b")]), W("c")])),
    ("(a OR b) c", Q.ands([Q.ors([W("a"), W("b")]), W("c")])),
]


@pytest.mark.parametrize(("text", "tree"), CASES)
def test_texts_to_trees(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text", ["", "(", "a OR", "[1 TO]", '"', "AND", "a ^", "()", "x:", "''"])
def test_errors(text):
    with pytest.raises(ParseError):
        parse(text)


words = st.text("abcXYZäß019", min_size=1, max_size=6).filter(lambda w: w not in Q.RESERVED)
leaves = st.one_of(
    st.builds(W, words, st.sampled_from([Q.CASE, Q.NOCASE, Q.FUZZY])),
    st.builds(Q.FullWord, words, st.sampled_from([Q.CASE, Q.NOCASE])),
    st.builds(Q.Range, words, words),
)
trees = st.recursive(
    leaves,
    lambda inner: st.one_of(
        st.builds(lambda o, a: Q.Seq(Q.Op(o), tuple(a)), st.sampled_from([Q.AND, Q.OR, Q.ANDNOT, Q.PHRASE]), st.lists(inner, min_size=2, max_size=3)),
        st.builds(lambda o, d, a: Q.Seq(Q.Op(o, d), tuple(a)), st.sampled_from(["near", "follow"]), st.integers(1, 9), st.lists(inner, min_size=2, max_size=2)),
        st.builds(lambda c, q: Q.InContexts(tuple(c), q), st.lists(st.sampled_from(["x", "y1"]), min_size=1, max_size=2), inner),
        st.builds(Q.Boost, st.sampled_from([0.5, 1.5, 2.0]), inner),
    ),
    max_leaves=6,
)


@given(trees)
@settings(max_examples=150, deadline=None)
def test_shown_trees_parse_to_themselves(tree):
    once = parse(Q.show(tree))
    assert Q.show(parse(Q.show(once))) == Q.show(once)
    assert Q.terms(once) == Q.terms(tree)


@given(trees)
@settings(max_examples=80, deadline=None)
def test_json_round_trip(tree):
    assert Q.from_json(Q.to_json(tree)) == tree


def test_binary_tags_and_operators():
    assert Q.from_json({"type": "and not", "query1": Q.to_json(W("a")), "query2": Q.to_json(W("b"))}) == Q.Binary(Q.Op(Q.ANDNOT), W("a"), W("b"))
    assert Q.from_json({"type": "near 3", "query1": Q.to_json(W("a")), "query2": Q.to_json(W("b"))}).op == Q.Op("near", 3)


def test_rewrites():
    assert Q.normal_form(Q.Phrase("a b")) == Q.nexts([Q.FullWord("a"), Q.FullWord("b")])
    assert Q.normal_form(Q.Binary(Q.Op(Q.AND), W("a"), Q.Binary(Q.Op(Q.AND), W("b"), W("c")))) == Q.ands([W("a"), W("b"), W("c")])
    assert Q.subsume_prefixes(Q.Binary(Q.Op(Q.AND), W("ha"), W("har"))) == W("har")
    assert Q.subsume_prefixes(Q.Binary(Q.Op(Q.OR), W("ha"), W("har"))) == W("ha")
    assert Q.completion_form(Q.Phrase("a b")) == Q.nexts([Q.FullWord("a"), W("b")])
    assert Q.complete_queries(parse("a AND b"), ["bx", "by"]) == [parse("a AND bx"), parse("a AND by")]
    assert Q.check_with(str.islower, parse("a OR b")) and not Q.check_with(str.islower, parse("a OR B"))
    assert Q.fuzzy(W("a")) == W("a", Q.FUZZY) and Q.fuzzy(parse("a b")) == parse("a b")
