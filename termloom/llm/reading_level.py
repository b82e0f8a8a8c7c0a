"""Reading level: every word's acquisition grade from graded texts, every document's level from calibrated quantiles.

A word's acquisition grade is the mean of the grades weighted by the word's share of the words of each grade. A
document is described by quantiles of the acquisition grades of its known words and gets the grade whose calibrated
quantiles (medians over the graded documents) lie nearest. Grades that the first fit contradicts are taken as slips of
the graders and left out of the second.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.subtitles import skeleton, speech, tokens
from termloom.runtime import checkpointed

#: At most so many graded documents are used (those with the smallest hash of their id).
MAX_GRADED = 20_000
#: Words seen less often in the graded texts stay unknown.
MIN_COUNT = 3
QUANTILES = np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])


def words(text: str | None) -> list[str]:
    return [skeleton(w) for w in tokens(speech(text))]


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = pa.array([" ".join(words(t)) for t in b.column(2).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], ["id", "grade", "words"])


def _word_counts(batches: Iterator[pa.RecordBatch], left_out: frozenset) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in batches:
        for i, g, text in zip(*(b.column(k).to_pylist() for k in range(3))):
            if i not in left_out:
                counts.update((w, g) for w in text.split())
    rows = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([g for _, g in rows], pa.int32()), pa.array([counts[r] for r in rows], pa.int64())], ["word", "grade", "n"])


def _profile(found: list[str], acquired: dict[str, float]) -> np.ndarray | None:
    known = np.array([a for a in map(acquired.get, found) if a is not None])
    if not len(known):
        return None
    known.sort()
    return known[np.minimum((QUANTILES * len(known)).astype(int), len(known) - 1)]


def _profiles(batches: Iterator[pa.RecordBatch], acquired: dict[str, float]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [None if p is None else p.tolist() for p in (_profile(t.split(), acquired) for t in b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.float64()))], ["id", "grade", "profile"])


def _grades(batches: Iterator[pa.RecordBatch], model: ReadingLevel) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grades = pa.array([model.grade(words(t)) for t in b.column(1).to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), grades], ["id", "grade"])


class ReadingLevel:
    """Fitted word grades and calibrated quantiles per grade."""

    def __init__(self, acquired: dict[str, float], levels: dict[int, np.ndarray], usual: int | None) -> None:
        self.acquired, self.levels, self.usual = acquired, levels, usual

    def grade(self, found: list[str]) -> int | None:
        """The nearest grade (ties: the lower); the most frequent grade for a text without known words; null unfitted."""
        p = _profile(found, self.acquired)
        if p is None or not self.levels:
            return self.usual
        return min(sorted(self.levels), key=lambda g: float(np.abs(self.levels[g] - p).sum()))

    @classmethod
    def fit(cls, docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, grade: str, max_graded: int = MAX_GRADED) -> ReadingLevel:
        """Fit on at most ``max_graded`` graded documents. Null grades are ignored, repeated rows count once, and a
        document graded differently has the lower median of its grades. No graded document: an unfitted model."""
        graded = (
            labels.where(F.col(grade).isNotNull()).select(F.col(label_id).alias("id"), F.col(grade).cast("int").alias("grade")).distinct()
            .groupBy("id").agg(F.percentile_approx("grade", 0.5, 10_000).alias("grade"))
            .orderBy(F.xxhash64("id"), "id").limit(max_graded)
        )
        kind = docs.schema[doc_id].dataType.simpleString()
        texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(graded), "id")
        sample = checkpointed(texts.select("id", "grade", "text").mapInArrow(_spoken, f"id {kind}, grade int, words string"))
        model, left_out = cls({}, {}, None), frozenset()
        for _ in range(2):
            counts = sample.mapInArrow(partial(_word_counts, left_out=left_out), "word string, grade int, n long").groupBy("word", "grade").agg(F.sum("n").alias("n")).collect()
            totals: Counter = Counter()
            by_word: dict[str, dict[int, int]] = {}
            for r in counts:
                totals[r["grade"]] += r["n"]
                by_word.setdefault(r["word"], {})[r["grade"]] = r["n"]
            acquired = {}
            for w, n in by_word.items():
                if sum(n.values()) >= MIN_COUNT:
                    share = {g: k / totals[g] for g, k in n.items()}
                    acquired[w] = sum(g * s for g, s in share.items()) / sum(share.values())
            rows = [r for r in sample.mapInArrow(partial(_profiles, acquired=acquired), f"id {kind}, grade int, profile array<double>").collect() if r["profile"]]
            kept = [r for r in rows if r["id"] not in left_out]
            levels = {g: np.median([r["profile"] for r in kept if r["grade"] == g], axis=0) for g in {r["grade"] for r in kept}}
            usual = min(Counter(r["grade"] for r in kept).most_common(), key=lambda x: (-x[1], x[0]))[0] if kept else None
            model = cls(acquired, levels, usual)
            nearest = lambda p: min(sorted(levels), key=lambda g: float(np.abs(levels[g] - p).sum()))
            left_out = frozenset(r["id"] for r in rows if nearest(np.array(r["profile"])) != r["grade"])
        return model

    def predict(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """doc_id, grade of every row."""
        kind = docs.schema[doc_id].dataType.simpleString()
        rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        return rows.mapInArrow(partial(_grades, model=self), f"id {kind}, grade int").withColumnRenamed("id", doc_id)
