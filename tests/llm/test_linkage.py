import random

import pytest
from pyspark.sql import functions as F

from termloom.llm.linkage import PATTERNS, FieldWeights, LinkStore, _compared, parse


def one_slip(a, b):
    """Brute force: a letter more, less, other, or two neighbouring letters swapped."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    return (x + y).isalpha() and (max(len(x), len(y)) == 1 or (len(x) == len(y) == 2 and x == y[::-1]))

SAME = [
    "https://blog.a.example/x/one-two-three",
    " HTTP://www.Blog.A.example:80/x//one-two-three/#top\t",
    "https://blog.a.example:443/./x/y/../one-tw%6f-three?utm_source=z&fbclid=1",
]


def test_spellings():
    assert len({parse(u)[0] for u in SAME}) == 1
    assert parse("https://a.example/caf%c3%a9-x-y")[0] == parse("http://a.example/café-x-y")[0]
    assert parse("https://a.example/v?b=2&a=1&sid=q")[0] == parse("https://a.example/v?a=1&b=2")[0]
    assert parse("ID:7 ")[0] == parse("id:7")[0] != parse("id:8")[0]
    different = ["https://a.example/v?page=1", "https://a.example/v?page=2", "https://a.example/v", "https://b.example/v", "https://a.example/V"]
    assert len({parse(u)[0] for u in different}) == len(different)
    assert parse("https://a.example/x/a-b/index.html")[0] == parse("https://a.example/x/a-b/")[0]
    below, slip = parse("https://a.example/x/one-two/page/2"), parse("https://a.example/x/one-tow/page/2")
    assert (below[1], below[2], below[3]) == ("a.example/x", "/page/2", "one-two") and one_slip(below[3], slip[3]) and below[2] == slip[2]
    assert parse("https://a.example/x/one-two/page/3")[2] != below[2]
    assert parse(None) is None and parse("  ") is None


@pytest.mark.parametrize(("a", "b", "yes"), [("one-two", "one-tow", True), ("one-two", "one-twoo", True), ("one-two", "on-two", True), ("one-two", "ome-two", True), ("one-two", "one-two", False), ("one-2", "one-3", False), ("one-two", "onetwo", False), ("one-two", "oen-tow", False)])
def test_one_slip(a, b, yes):
    assert one_slip(a, b) is yes and one_slip(b, a) is yes


def run(spark, tmp_path, batches):
    store = LinkStore(spark, str(tmp_path / "store"))
    frame = lambda rows: spark.createDataFrame([(i, u, "clash", 0) for i, u in rows], "id bigint, u string, spelling string, rep int")
    store.load_history(frame(batches[0]), "id", "u")
    return [sorted((r["first_id"], r["record_id"]) for r in store.accept(frame(b), "id", "u").collect()) for b in batches[1:]]


def test_batches(spark, tmp_path):
    base = "https://h.example/d/"
    got = run(spark, tmp_path, [
        [(1, base + "alpha-beta-gamma"), (2, base + "alpha-beta-delta-1"), (3, "id:5"), (4, None)],
        [(10, base + "alpha-beta-gamam"), (11, base + "new-page-here"), (12, "http://h.example/d/new-page-here/"), (13, base + "alpha-beta-delta-2"), (14, None), (15, " ")],
        [(20, base + "new-pgae-here"), (21, "ID:5"), (22, base + "alpha-beta-gamma?utm_medium=x"), (22, base + "alpha-beta-gamma?utm_medium=x"), (23, base + "alpha-beta-gammaa")],
        [],
    ])
    assert got == [[(1, 10), (11, 12)], [(1, 22), (1, 23), (3, 21), (11, 20)], []]


def test_a_batch_joins_two_clusters(spark, tmp_path):
    """b lies one slip from a and from c, which are two slips apart."""
    base = "https://h.example/d/"
    got = run(spark, tmp_path, [[(1, base + "aaaa-bbbb-cccc")], [(2, base + "aaxx-bbbb-cccc")], [(3, base + "aaax-bbbb-cccc")], [(4, base + "aaxx-bbbb-cccc")]])
    assert got == [[], [(1, 3)], [(1, 4)]]


def test_against_brute_force(spark, tmp_path):
    """Random names in few directories, many of them one or two slips or a digit apart, over three batches."""
    dice = random.Random(5)
    names = ["-".join("".join(dice.choice("abo1") for _ in range(dice.randint(2, 4))) for _ in range(3)) for _ in range(60)]

    def near(n):
        k = dice.randrange(len(n))
        return dice.choice([n[:k] + n[k + 1 :], n[:k] + dice.choice("ab1-") + n[k:], n[:k] + dice.choice("ab2") + n[k + 1 :], n[:k] + n[k : k + 2][::-1] + n[k + 2 :], n])

    uri = lambda n: f"https://h.example/{dice.choice('xy')}/{n}{dice.choice(['', '.html'])}"
    history, seen = [], []
    for k, n in enumerate(names):
        u = uri(n)
        p = parse(u)
        if p[3] and not any(p == q or (p[1:3] == q[1:3] and one_slip(p[3], q[3])) for q in seen):
            history.append((k, u))
            seen.append(p)
    batches = [[(100 * b + k, uri(near(near(dice.choice(names))))) for k in range(60)] for b in (1, 2)]
    got = run(spark, tmp_path, [history, *batches])
    rows, parent = list(history), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for batch, links in zip(batches, got):
        rows += batch
        parsed = {i: parse(u) for i, u in rows}
        for a in parsed:
            for b in parsed:
                p, q = parsed[a], parsed[b]
                if p[0] == q[0] or (p[3] and q[3] and p[1:3] == q[1:3] and one_slip(p[3], q[3])):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
        want = [(find(i), i) for i, _ in batch if find(i) < i]
        assert links == sorted(want)


def test_another_session_goes_on(spark, tmp_path):
    """A store opened again links to what was accepted before, with the weights learned before, and a batch that failed
    before its commit can be given again."""
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, u string")
    path, base = str(tmp_path / "store"), "https://h.example/d/"
    LinkStore(spark, path).load_history(frame([(1, base + "alpha-beta"), (2, "id:7")]), "id", "u")
    first = LinkStore(spark, path)
    assert first.batches == 1
    first._commit = lambda: None
    batch = frame([(10, base + "alhpa-beta"), (11, "ID:7"), (12, base + "new-page")])
    first.accept(batch, "id", "u")
    again = LinkStore(spark, path)
    assert again.batches == 1
    assert sorted(map(tuple, again.accept(batch, "id", "u").collect())) == [(1, 10), (2, 11)]
    third = LinkStore(spark, path)
    assert third.batches == 2 and third.weights.state() == again.weights.state() and sum(third.weights.candidates) == 1
    assert sorted(map(tuple, third.accept(frame([(20, base + "new-pgae"), (21, base + "alhpa-beta"), (22, base + "alhpa-betaa")]), "id", "u").collect())) == [(1, 21), (1, 22), (12, 20)]
    late = LinkStore(spark, path)
    late.batches = 0
    with pytest.raises(RuntimeError):
        late._commit()


def test_history_is_not_exchanged(spark, tmp_path):
    store = LinkStore(spark, str(tmp_path / "store"))
    store.load_history(spark.range(200).select("id", F.concat(F.lit("http://h.example/d/page-"), F.col("id").cast("string")).alias("u")), "id", "u")
    store.accept(spark.createDataFrame([(900, "http://h.example/d/pgae-7")], "id bigint, u string"), "id", "u")
    every = store.keys.read(2)
    plan = _compared(every.where("batch = 1"), every)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Join")[1]
    assert "Bucketed: true" in below and "Exchange hashpartitioning(key" not in below


def test_the_score_decides(spark, tmp_path, monkeypatch):
    """Other digits and moved letters are candidates too; without the learned weights they would be linked."""
    rows = [[(k, f"https://h.example/d/page-{k}-abcd") for k in range(30)], [(100, "https://h.example/d/page-99-abcd"), (101, "https://h.example/d/pgae-7-abcd"), (102, "https://h.example/d/page-8-bcda")]]
    assert run(spark, tmp_path / "a", rows) == [[(7, 101)]]
    monkeypatch.setattr(FieldWeights, "linked", lambda self: [True] * len(PATTERNS))
    assert run(spark, tmp_path / "b", rows) != [[(7, 101)]]


def test_many_copies_of_one_resource(spark, tmp_path):
    got = run(spark, tmp_path, [[(0, "https://h.example/d/one-two")], [(i, "https://h.example/d/one-two#x") for i in range(1, 400)]])
    assert got == [[(0, i) for i in range(1, 400)]]


def test_weights():
    yes, no = (True,) * 4, [p for p in PATTERNS if not all(p)]
    fresh = FieldWeights()
    assert fresh.score(yes) > 0 and all(fresh.score(p) < 0 for p in no)
    w = FieldWeights()
    digits = PATTERNS.index((True, False, False, True))
    w.learn_different([4000 * (k == digits) for k in range(16)])
    w.learn([{digits: 500, 15: 60}.get(k, 0) for k in range(16)])
    assert w.score(yes) > fresh.score(yes) and all(w.score(p) < 0 for p in no)
    same = FieldWeights.from_state(w.state())
    assert [same.score(p) for p in PATTERNS] == [w.score(p) for p in PATTERNS]


def test_page_names_above_hyphenated_numbers():
    a, b = (parse(f"http://a.example/2011/05/{name}/page/6829-8685.html") for name in ("vuzukra-filadi-tree", "vuzukra-filadi-tre"))
    assert a[1:4] == ("a.example/2011/05", "/page/6829-8685.html", "vuzukra-filadi-tree")
    assert a[1:3] == b[1:3] and one_slip(a[3], b[3])
    assert parse("http://a.example/x/2914-8254")[3] is None
    assert parse("http://a.example/x/some-page.html")[1:4] == ("a.example/x", ".html", "some-page")
