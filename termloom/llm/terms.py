"""Terms of a text and their run-length statistics.

A term is a maximal run of letters and digits, lower-cased, otherwise as written.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.runtime import checkpointed

TERM = re.compile(r"[^\W_]+")
#: Characters sorted in memory at once; a longer single text still goes whole.
BLOCK_CHARS = 16_000_000


def terms_of(text: str | None) -> list[str]:
    """Terms in order; none for a null text."""
    return TERM.findall(text.lower()) if text else []


def _runs(texts: list[str | None]) -> pa.RecordBatch:
    """Sort the (term, record) pairs of a block and scan the sorted pairs by run length."""
    tokens: list[str] = []
    lengths = []
    for t in texts:
        found = terms_of(t)
        tokens += found
        lengths.append(len(found))
    coded = pa.array(tokens, pa.string()).dictionary_encode()
    words = np.asarray(coded.dictionary.to_pylist(), dtype=object)
    order = np.argsort(words, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    record = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    pairs = rank[coded.indices.to_numpy(zero_copy_only=False)] * max(1, len(texts)) + record
    pairs.sort()
    new_pair = np.ones(len(pairs), bool)
    new_pair[1:] = pairs[1:] != pairs[:-1]
    term = pairs // max(1, len(texts))
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
    occurrences = np.diff(np.r_[starts, len(term)])
    records = np.add.reduceat(new_pair.astype(np.int64), starts) if len(starts) else starts
    # The run of the null term carries the block's number of records and of tokens.
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None, *words[order]], pa.string()),
            pa.array(np.r_[len(term), occurrences], pa.int64()),
            pa.array(np.r_[len(texts), records], pa.int64()),
        ],
        ["term", "occurrences", "records"],
    )


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block: list[str | None] = []
    chars = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            block.append(text)
            chars += len(text or "")
            if chars >= BLOCK_CHARS:
                yield _runs(block)
                block, chars = [], 0
    if block:
        yield _runs(block)


def _merged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by term -> one row per term: equal neighbours are one run, also across batches."""
    names = ["term", "occurrences", "records"]
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        term = b.column(0)
        new = np.r_[True, np.asarray(pc.not_equal(term[1:], term[:-1]))] if b.num_rows > 1 else np.array([True])
        starts = np.flatnonzero(new)
        terms = term.take(pa.array(starts))
        occurrences = np.add.reduceat(b.column(1).to_numpy(), starts)
        records = np.add.reduceat(b.column(2).to_numpy(), starts)
        if last is not None and last[0] == terms[0].as_py():
            occurrences[0] += last[1]
            records[0] += last[2]
        elif last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, (pa.string(), pa.int64(), pa.int64()))], names)
        last = (terms[-1].as_py(), int(occurrences[-1]), int(records[-1]))
        yield pa.RecordBatch.from_arrays([terms[:-1], pa.array(occurrences[:-1], pa.int64()), pa.array(records[:-1], pa.int64())], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, (pa.string(), pa.int64(), pa.int64()))], names)


class TermStatistics:
    """Occurrences and records of every term of one text column, by an external sort.

    Each task sorts the (term, record) pairs of its blocks and scans them by run length; these sorted runs, one row per
    term and block, are written, range-partitioned by term, merged by Spark's external sort, and scanned by run length
    once more. A record lies in one block, so its numbers add up. A hot term is one row per block, whatever share of the
    rows it has.

    Every row is one record: repeated rows count as often as they come. A null text is a record without terms, as an
    empty one is. Other columns of ``df`` are not read, so their names do not matter. An empty table has no terms,
    0 records and 0 tokens.
    """

    def __init__(self, df: DataFrame, text: str) -> None:
        column = df[text].alias("text")
        self._runs = checkpointed(df.select(column).mapInArrow(_sorted_runs, "term string, occurrences long, records long"))
        total = self._runs.where("term is null").agg(F.sum("records").alias("r"), F.sum("occurrences").alias("o")).first()
        self.n_records: int = total["r"] or 0
        self.n_tokens: int = total["o"] or 0

    def table(self) -> DataFrame:
        """term, occurrences, records; in the order of terms, within and across partitions."""
        runs = self._runs.where("term is not null").repartitionByRange("term").sortWithinPartitions("term")
        return runs.mapInArrow(_merged_runs, "term string, occurrences long, records long")

    def verdicts(self, rare_records: int = 2, common_percent: int = 55) -> DataFrame:
        """term, occurrences, records, verdict: 'rare' in at most ``rare_records`` records, 'common' in at least
        ``common_percent`` of 100 records, else null. In a collection so small that both hold, 'rare' stands."""
        verdict = F.when(F.col("records") <= rare_records, "rare").when(
            F.col("records") * 100 >= F.lit(common_percent * self.n_records), "common"
        )
        return self.table().withColumn("verdict", verdict)


def frequencies(min_tf: int, ids: str):
    """mapInArrow function: (id, text) -> (id, term, tf, length) for terms with at least ``min_tf`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_id, out_term, out_tf, out_len = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms_of(text)
                if len(found) < min_tf:
                    continue
                for term, tf in Counter(found).items():
                    if tf >= min_tf:
                        out_id.append(i)
                        out_term.append(term)
                        out_tf.append(tf)
                        out_len.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_id, batch.schema.field(0).type), pa.array(out_term, pa.string()), pa.array(out_tf, pa.int64()), pa.array(out_len, pa.int64())],
                [ids, "term", "tf", "length"],
            )

    return run
