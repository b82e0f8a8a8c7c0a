"""Deduplicating new batches against all history: incremental record linkage over URIs.

Accepted spellings and their blocking keys are tables in a shared folder, hash-distributed by key, so a new batch is
joined to them without an exchange of what was accepted before. The fields of the candidate pairs are scored with
weights learned from pairs that are known to be different and, by expectation maximisation, from the batches; the score
alone decides. A link updates only the clusters it touches, through a union-find mapping from spellings to
representatives. Another session can open the folder and go on.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import product
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from termloom.runtime import BucketedTable, hadoop_path, names_in, read_text, shared_path, together, write_text, written

#: Parameters that only track a visit.
TRACKING = re.compile(r"(?:utm_\w*|fbclid|gclid|dclid|msclkid|yclid|mc_[ce]id|igshid|ref_src|sid|sessionid|phpsessid|jsessionid)", re.I)
_INDEX = re.compile(r"(?:index|default)\.(?:x?html?|shtml|php\d?|aspx?|jsp)", re.I)
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)", re.S)
#: What is compared of two page names in one directory and with one tail.
FIELDS = ("one_edit", "letters_only", "same_digits", "same_words")
PATTERNS = tuple(product((False, True), repeat=len(FIELDS)))


def _escaped(part: str) -> str:
    return quote(unicodedata.normalize("NFC", unquote(part, errors="replace")), safe="/:@!$&'()*+,;=~-._")


def _name_and_extension(segment: str) -> tuple[str, str]:
    name, dot, extension = segment.rpartition(".")
    if not dot or not re.fullmatch(r"[A-Za-z0-9]{1,5}", extension) or extension.isdigit():
        return segment, ""
    return name, dot + extension


def parse(uri: str | None) -> tuple | None:
    """(spelling, directory, tail, page); None without a resource.

    The spelling is equal for URIs that differ only in what servers and browsers ignore: blanks around, protocol,
    ``www.``, case of scheme and host, default ports, dot segments, repeated and final slashes, a directory's default
    document, escapes, fragments, order of parameters and tracking parameters. ``page`` is the last hyphenated path
    segment that holds letters (null if there is none), ``tail`` its extension and all that follows.
    """
    uri = re.sub(r"[\t\r\n]", "", uri or "").strip().strip("​﻿⁠")
    if not uri:
        return None
    m = _SCHEME.fullmatch(uri)
    scheme, rest = (m[1].lower(), m[2]) if m else ("", uri)
    if scheme not in ("http", "https"):
        return (f"{scheme}:{unicodedata.normalize('NFC', rest.strip())}", None, None, None)
    rest = rest.lstrip("/\\").partition("#")[0]
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    host = host.rpartition("@")[2].lower()
    host = re.sub(r":(?:80|443)?$", "", host).rstrip(".")
    host = host.removeprefix("www.")
    segments: list[str] = []
    for s in _escaped(path).split("/"):
        if s == "..":
            segments[-1:] = []
        elif s not in ("", "."):
            segments.append(s)
    if segments and _INDEX.fullmatch(segments[-1]):
        segments.pop()
    params = sorted(_escaped(p) for p in query.split("&") if p and not TRACKING.fullmatch(p.partition("=")[0]))
    query = "?" + "&".join(params) if params else ""
    spelling = "//" + "/".join([host, *segments]) + query
    parts = map(_name_and_extension, segments)
    at, (name, extension) = max(((i, p) for i, p in enumerate(parts) if "-" in unquote(p[0]) and re.search(r"[^\W\d_]", unquote(p[0]))), default=(None, ("", "")))
    if at is None:
        return (spelling, None, None, None)
    directory = "/".join([host, *segments[:at]])
    tail = "/".join([extension, *segments[at + 1 :]]) + query
    return (spelling, directory, tail, unquote(name))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, *p) for i, p in zip(b.column(0).to_pylist(), map(parse, b.column(1).to_pylist())) if p]
        columns = list(zip(*rows)) if rows else [[] for _ in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), *[pa.string()] * 4])], ["record_id", "spelling", "directory", "tail", "page"])


class FieldWeights:
    """Log-likelihood ratios of the agreement patterns of FIELDS.

    How unrelated pairs look is learned from pairs known to be different, as a table of all patterns; how linked ones
    look, field by field, and how many there are, by expectation maximisation over the counts of the patterns in the
    batches (16 numbers, whatever the number of pairs). Pseudo-counts stand for what few pairs can't tell: a slip
    leaves digits and words alone and is one edit of letters; unrelated candidates may look like anything.
    """

    PRIOR_M, PSEUDO_M, PSEUDO_U, SHARE, PSEUDO_SHARE = 0.999, 100.0, 16.0, 0.1, 10.0

    def __init__(self) -> None:
        self.different = [0] * len(PATTERNS)
        self.candidates = [0] * len(PATTERNS)
        self._fit()

    def learn_different(self, counts: list[int]) -> None:
        self.different = [a + b for a, b in zip(self.different, counts)]
        self._fit()

    def learn(self, counts: list[int]) -> None:
        self.candidates = [a + b for a, b in zip(self.candidates, counts)]
        self._fit()

    def _fit(self, rounds: int = 30) -> None:
        self.m, self.share = [self.PRIOR_M] * len(FIELDS), self.SHARE
        flat = self.PSEUDO_U / len(PATTERNS)
        total = sum(self.different) + self.PSEUDO_U
        self.u = [(n + flat) / total for n in self.different]
        n_all = sum(self.candidates)
        for _ in range(rounds):
            post = [n / (1 + math.exp(-self.score(p))) for n, p in zip(self.candidates, PATTERNS)]
            linked = sum(post)
            for f in range(len(FIELDS)):
                agree = sum(x for x, p in zip(post, PATTERNS) if p[f])
                self.m[f] = (agree + self.PRIOR_M * self.PSEUDO_M) / (linked + self.PSEUDO_M)
            apart = [n - x for n, x in zip(self.candidates, post)]
            self.u = [(n + x + flat) / (total + n_all - linked) for n, x in zip(self.different, apart)]
            self.share = (linked + self.SHARE * self.PSEUDO_SHARE) / (n_all + self.PSEUDO_SHARE)

    def score(self, pattern: tuple[bool, ...]) -> float:
        """Log odds that a pair with this pattern is one resource; linked from 0 on."""
        k = sum(yes << (len(FIELDS) - 1 - i) for i, yes in enumerate(pattern))
        alike = sum(math.log(m if yes else 1 - m) for m, yes in zip(self.m, pattern))
        return alike - math.log(self.u[k]) + math.log(self.share / (1 - self.share))

    def linked(self) -> list[bool]:
        return [self.score(p) >= 0 for p in PATTERNS]

    def state(self) -> dict:
        return {"different": self.different, "candidates": self.candidates}

    @classmethod
    def from_state(cls, state: dict) -> FieldWeights:
        made = cls()
        made.different, made.candidates = state["different"], state["candidates"]
        made._fit()
        return made


def _pattern() -> Column:
    """Number of a pair's agreement pattern in PATTERNS."""
    bits = [F.col(f).cast("int") * (1 << (len(FIELDS) - 1 - i)) for i, f in enumerate(FIELDS)]
    return reduce(Column.__add__, bits)


def _pattern_counts() -> list[Column]:
    return [F.sum((F.col("pattern") == k).cast("long")).alias(f"n{k}") for k in range(len(PATTERNS))]


def _counts_in(row: dict) -> list[int]:
    return [row.get(f"n{k}") or 0 for k in range(len(PATTERNS))]


def _name_keys(spellings: DataFrame) -> DataFrame:
    """key, chk, id, at, ch: the page name and all that is left of it without one character (``ch``, the ``at``-th),
    hashed with directory and tail. Names one edit apart share a key, and a key is shared only by names one or two edits
    apart in one directory with one tail, so no block grows with a directory, a host or a common word."""
    page = F.col("page")
    left_out = F.transform(F.sequence(F.lit(1), F.length(page)), lambda i: F.struct(
        i.cast("short").alias("at"), F.substring(page, i, F.lit(1)).alias("ch"), F.concat(F.substring(page, F.lit(1), i - 1), F.substring(page, i + 1, F.length(page))).alias("rest")))
    whole = F.array(F.struct(F.lit(-1).cast("short").alias("at"), F.lit("").alias("ch"), page.alias("rest")))
    rows = spellings.where("page is not null").select("id", "block", F.inline(F.concat(whole, left_out)))
    return rows.select(F.xxhash64("block", "rest").alias("key"), F.hash("block", "rest").alias("chk"), "id", "at", "ch")


def _compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b, pattern: the pairs that share a key, with the fields' agreement. What was left out of either name tells how
    they differ: the same place is another character, neighbouring places with one character are a swap, nothing on
    one side is a character more. A pair that shares several keys is judged by those that make it one edit."""
    left = a.select("key", "chk", F.col("id").alias("a"), F.col("at").alias("at_a"), F.col("ch").alias("ch_a"))
    right = b.select("key", "chk", F.col("id").alias("b"), F.col("at").alias("at_b"), F.col("ch").alias("ch_b"), "batch")
    chars = F.concat("ch_a", "ch_b")
    swap = (F.abs(F.col("at_a") - F.col("at_b")) == 1) & (F.col("ch_a") == F.col("ch_b"))
    edit = (F.col("at_a") == F.col("at_b")) | (F.col("at_a") < 0) | (F.col("at_b") < 0) | swap
    met = left.join(right, ["key", "chk"]).where("a <> b")
    fields = {"letters_only": chars.rlike(r"^\p{L}*$"), "same_digits": ~chars.rlike(r"\p{Nd}"), "same_words": ~chars.contains("-")}
    met = met.select("a", "b", "batch", edit.alias("one_edit"), *[c.alias(n) for n, c in fields.items()])
    judged = [F.coalesce(F.min(F.when(F.col("one_edit"), F.col(n))), F.min(n)).alias(n) for n in fields]
    pairs = met.groupBy("a", "b").agg(F.min("batch").alias("batch"), F.max("one_edit").alias("one_edit"), *judged)
    return pairs.select("a", "b", "batch", _pattern().alias("pattern"))


class LinkStore:
    """Accepted records of all batches so far, in a folder all executors share; opens what is already there.

    ``spellings``: one row per distinct spelling, by hash, with its ``id``, the smallest record of the batch that brought
    it. ``keys``: the blocking keys of its page name, with the characters left out. ``merged``: (id, rep) for spellings
    whose cluster has a smaller representative; the smallest holds. A batch counts once ``commits/<n>`` is there, with
    the weights learned by then; what a failed batch left is overwritten by the next attempt.

    Nulls and blank URIs name no resource. Repeated rows of one record are one. Other columns are not read.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        fs, p = hadoop_path(spark, path or shared_path(spark, "linkage"))
        self.path = fs.makeQualified(p).toString()
        done = sorted(int(n) for n in names_in(spark, f"{self.path}/commits") if n.isdigit())
        self.batches = done[-1] + 1 if done else 0
        state = json.loads(read_text(spark, f"{self.path}/commits/{done[-1]}")) if done else {}
        self.weights = FieldWeights.from_state(state["weights"]) if done else FieldWeights()
        self.buckets = state.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = lambda name, schema, *keys: BucketedTable(spark, f"{self.path}/{name}", schema, keys, self.buckets)
        self.spellings = table("spellings", "key long, chk int, id long", "key", "chk")
        self.keys = table("keys", "key long, chk int, id long, at short, ch string", "key", "chk")
        self.merged = table("merged", "id long, rep long", "id")

    def _staged(self, df: DataFrame, record_id: str, uri: str) -> DataFrame:
        """key, chk, record_id, block, page of the batch's records, parsed once and written."""
        rows = df.where(F.col(record_id).isNotNull()).select(F.col(record_id).cast("long").alias("record_id"), F.col(uri).alias("uri"))
        parsed = rows.mapInArrow(_parsed, "record_id long, spelling string, directory string, tail string, page string")
        hashed = parsed.select(F.xxhash64("spelling").alias("key"), F.hash("spelling").alias("chk"), "record_id", F.xxhash64("directory", "tail").alias("block"), "page")
        return written(hashed, f"{self.path}/staged/{self.batches}")

    @staticmethod
    def _distinct(staged: DataFrame) -> DataFrame:
        return staged.groupBy("key", "chk").agg(F.min("record_id").alias("id"), F.first("block").alias("block"), F.first("page").alias("page"))

    def _add(self, new: DataFrame) -> None:
        n = self.batches
        together(lambda: self.spellings.write(new, n), lambda: self.keys.write(_name_keys(new), n))

    def _commit(self) -> None:
        """The batch counts from here on; of two writers of one batch the later fails."""
        state = json.dumps({"weights": self.weights.state(), "buckets": self.buckets})
        if not write_text(self.spark, f"{self.path}/commits/{self.batches}", state, exclusive=True):
            raise RuntimeError(f"batch {self.batches} was committed by another writer")
        self.batches += 1

    def load_history(self, df: DataFrame, record_id: str, uri: str) -> None:
        """Accept records that repeat nothing beyond equal spellings. Their candidate pairs teach how different
        resources look."""
        self._add(self._distinct(self._staged(df, record_id, uri)))
        own = self.keys.read(self.batches + 1).where(F.col("batch") == self.batches)
        row = _compared(own, own).where("a > b").agg(*_pattern_counts()).first()
        self.weights.learn_different(_counts_in(row.asDict()))
        self._commit()

    def accept(self, df: DataFrame, record_id: str, uri: str) -> DataFrame:
        """Link a batch and add it: (first_id, record_id) of its records whose resource an earlier record named."""
        n = self.batches
        staged = self._staged(df, record_id, uri)
        known = self.spellings.read(n).select("key", "chk", F.col("id").alias("known_id"))
        # A later batch may bring an older record; the smaller id leads either way.
        older = Observation()
        own = self._distinct(staged).join(known, ["key", "chk"], "left").observe(older, F.sum((F.col("id") < F.col("known_id")).cast("long")).alias("n"))
        own = written(own, f"{self.path}/own/{n}")
        self._add(own.where("known_id is null"))
        every = self.keys.read(n + 1)
        seen = Observation()
        pairs = _compared(every.where(F.col("batch") == n), every).where((F.col("batch") < n) | (F.col("b") < F.col("a")))
        pairs = written(pairs.observe(seen, *_pattern_counts()), f"{self.path}/pairs/{n}")
        counts = _counts_in(seen.get)
        self.weights.learn(counts)
        linked = [k for k, yes in enumerate(self.weights.linked()) if yes]
        edges = pairs.where(F.col("pattern").isin(linked)).select("a", "b")
        if older.get["n"]:
            edges = edges.unionByName(own.where("id < known_id").select(F.col("id").alias("a"), F.col("known_id").alias("b")))
        before = self._reps(self.merged.read(n))
        moved = self._union(edges, before) if older.get["n"] or sum(counts[k] for k in linked) else self.spark.createDataFrame([], "id long, rep long")
        node = own.select("key", "chk", F.coalesce("known_id", "id").alias("id"))
        now = self._reps(self.merged.read(n).select("id", "rep").unionByName(moved))
        rep = node.join(now, "id", "left").select("key", "chk", F.coalesce("rep", "id").alias("first_id"))
        out = staged.select("key", "chk", "record_id").join(rep, ["key", "chk"]).where("first_id < record_id").select("first_id", "record_id").distinct()
        _, out = together(lambda: self.merged.write(moved, n), lambda: written(out, f"{self.path}/repeats/{n}"))
        self._commit()
        return out

    @staticmethod
    def _reps(merged: DataFrame) -> DataFrame:
        """(id, rep): current representative of every spelling that is not its own."""
        return merged.groupBy("id").agg(F.min("rep").alias("rep"))

    def _union(self, edges: DataFrame, before: DataFrame) -> DataFrame:
        """New rows of the mapping: union-find over the touched clusters only, by minimum labels and path halving."""
        n = self.batches
        lead = edges.join(before.select(F.col("id").alias("b"), "rep"), "b", "left").select("a", F.coalesce("rep", "b").alias("b")).where("a <> b")
        graph = written(lead.unionByName(lead.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{self.path}/graph/{n}")
        label = graph.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"))
        step = 0
        while True:
            near = graph.join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
            up = label.join(label.select(F.col("a").alias("label"), F.col("label").alias("up")), "label", "left")
            changed = Observation()
            after = up.join(near, "a").select("a", F.least("near", F.coalesce("up", "label"), "label").alias("label"), F.col("label").alias("was"))
            after = after.observe(changed, F.sum((F.col("label") < F.col("was")).cast("long")).alias("n")).select("a", "label")
            label = written(after, f"{self.path}/labels/{n}-{step}")
            step += 1
            if not changed.get["n"]:
                break
        down = label.where("label < a").select(F.col("a").alias("id"), F.col("label").alias("rep"))
        if not n:
            return down
        # Spellings merged before whose representative has moved.
        older = before.join(down.select(F.col("id").alias("rep"), F.col("rep").alias("to")), "rep").select("id", F.col("to").alias("rep"))
        return written(down.unionByName(older), f"{self.path}/moved/{n}")
