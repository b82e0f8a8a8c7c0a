import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from termloom.llm.distinctiveness import distinctive_terms, query_words
from termloom.llm.terms import TermStatistics, terms_of

TEXTS = ["The cat, the CAT_dog 12!", "", None, "Ünï cat x1", "the " * 300, "cat", "cat"]
DF = "id bigint, body string, term string, records int"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(TEXTS)], DF).repartition(3)


def test_terms():
    assert terms_of("Full_width ＡＢ x-1 é") == ["full", "width", "ａｂ", "x", "1", "é"]
    assert terms_of(None) == terms_of("  ._ ") == []


def test_statistics_against_brute_force(rows):
    stats = TermStatistics(rows, "body")
    occurrences, records = Counter(), Counter()
    for t in TEXTS:
        found = terms_of(t)
        occurrences.update(found)
        records.update(set(found))
    assert stats.n_records == len(TEXTS) and stats.n_tokens == sum(occurrences.values())
    assert {r["term"]: (r["occurrences"], r["records"]) for r in stats.table().collect()} == {t: (n, records[t]) for t, n in occurrences.items()}
    verdicts = {r["term"]: r["verdict"] for r in stats.verdicts(rare_records=1).collect()}
    assert verdicts["cat"] == "common" and verdicts["the"] is None and verdicts["dog"] == "rare"


def test_table_comes_in_order(spark, monkeypatch):
    """Small blocks, so that terms come in several runs, over several range partitions."""
    from termloom.llm import terms

    monkeypatch.setattr(terms, "BLOCK_CHARS", 200)
    texts = [" ".join(f"w{(i * k) % 97}" for k in range(40)) for i in range(60)]
    stats = TermStatistics(spark.createDataFrame([(t,) for t in texts], "body string").repartition(3), "body")
    got = [(r["p"], r["term"]) for r in stats.table().withColumn("p", F.spark_partition_id()).collect()]
    assert [t for _, t in got] == sorted({w for t in texts for w in t.split()}) and got == sorted(got)
    plan = stats.table()._jdf.queryExecution().executedPlan().toString()
    assert "Sort [term" in plan and "rangepartitioning(term" in plan


def test_runs_merge_over_batches():
    import pyarrow as pa

    from termloom.llm.terms import _merged_runs

    rows = [("a", 1, 1), ("a", 2, 1), ("b", 5, 2), ("b", 1, 1), ("b", 1, 1), ("c", 1, 1)]
    for cut in range(len(rows) + 1):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], [pa.string(), pa.int64(), pa.int64()][k]) for k in range(3)], ["term", "occurrences", "records"]) for part in (rows[:cut], rows[cut:])]
        got = [tuple(r.values()) for b in _merged_runs(iter(batches)) for r in b.to_pylist()]
        assert got == [("a", 3, 2), ("b", 7, 4), ("c", 1, 1)]


def test_empty(spark):
    stats = TermStatistics(spark.createDataFrame([], DF), "body")
    assert (stats.n_records, stats.n_tokens, stats.table().count()) == (0, 0, 0)
    assert distinctive_terms(spark.createDataFrame([], DF), "id", "body").count() == 0


def test_scores_against_brute_force(rows):
    got = defaultdict(list)
    for r in distinctive_terms(rows, "id", "body").collect():
        got[r["id"], r["term"]].append(r["score"])
    counts = [Counter(terms_of(t)) for t in TEXTS]
    mean_length = sum(sum(c.values()) for c in counts) / len(TEXTS)
    total = sum(counts, Counter())
    want = defaultdict(list)
    for i, c in enumerate(counts):
        for term, tf in c.items():
            m = total[term] / len(TEXTS)
            tfn = tf * math.log2(1 + mean_length / sum(c.values()))
            want[i if i != 3 else None, term].append((math.log2(1 + m) + tfn * math.log2((1 + m) / m)) / (tfn + 1))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_selection(rows, spark):
    wanted = spark.createDataFrame([("the",), ("the",), ("cat",)], "term string")
    got = distinctive_terms(rows, "id", "body", min_tf=2, max_share=0.5, wanted=wanted).collect()
    assert {(r["id"], r["term"], r["tf"]) for r in got} == {(0, "the", 2), (4, "the", 300)}


def test_query_words(spark):
    queries = {"a AND NOT Bee": ["a", "bee"], "cx,who: x^1.5 OR y": ["x", "y"], '"in the box" NEAR 3 z': ["in", "the", "box", "z"], "[k1 TO k9]": ["k1", "k9"], "sand or": ["sand", "or"], "ANDY": ["andy"]}
    df = spark.createDataFrame([(q,) for q in queries], "q string")
    assert {r["q"]: r["w"] for r in df.select("q", query_words(F.col("q")).alias("w")).collect()} == queries
    assert not any(re.search("AND", w) for ws in queries.values() for w in ws)
