"""Held-out test items that leaked into a corpus, found by template canonicalisation.

Numbers, names and units become typed placeholders; windows of the templates are hash-joined between items and
documents; the slots of a joined window decide: equal slots are a leaked passage, other but consistently replaced
slots a re-parameterised question.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.subtitles import skeleton, speech, tokens
from termloom.runtime import checkpointed

WINDOW = 12
#: Bits of the filter that windows of documents pass before they are joined: so many for each window of the items,
#: within these bounds. It only saves work; the join decides.
BITS_PER_WINDOW, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 26
#: A window with fewer words that are no slots is matched by its words, not by its template: it would be one key for
#: every table of numbers or list of names.
LITERAL_WORDS = 2
NUMBER, NAME, UNIT = "\0number", "\0name", "\0unit"
_SENTENCE_END = re.compile(r"[.?!:]\s*$")


def _id(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Templates:
    """Which words are slots, learned from all items: numbers by form, units as what follows a number there, names as
    what is capitalised inside a sentence there. Words that no item has are names, in any case. Within a window, what
    follows a number is a unit, whatever the word; the first word of a window is typed alone, so a passage looks the
    same everywhere."""

    def __init__(self, texts: list[str | None]) -> None:
        self.names: set[str] = set()
        self.units: set[str] = set()
        self.words: set[str] = set()
        self.lower: set[str] = set()
        for text in filter(None, texts):
            for sentence in re.split(r"(?<=[.?!])\s+", text):
                found = tokens(sentence)
                for i, w in enumerate(found):
                    s = skeleton(w)
                    self.words.add(s)
                    if w.islower():
                        self.lower.add(s)
                    if i and w.istitle():
                        self.names.add(s)
                    if i and skeleton(found[i - 1]).isdigit() and w.islower():
                        self.units.add(s)
        self.names -= self.lower
        self.cache: dict[str, tuple[int, int]] = {}

    @classmethod
    def fitted(cls, texts: DataFrame) -> Templates:
        """From all texts of a DataFrame (text), block by block in the tasks; the driver gets their distinct words."""
        found = texts.mapInArrow(_vocabulary, "word string, kind string").distinct().collect()
        made = cls([])
        for word, kind in found:
            getattr(made, kind).add(word)
        made.names -= made.lower
        return made

    def token(self, word: str) -> tuple[int, int]:
        """Template id of a word, and the id of the word itself."""
        hit = self.cache.get(word)
        if hit is None:
            s = skeleton(word)
            kind = NUMBER if s.isdigit() else NAME if s in self.names else UNIT if s in self.units else None
            if kind is None and s not in self.words:
                kind = NAME
            hit = (_id(kind or s), _id(s))
            if len(self.cache) < 500_000:
                self.cache[word] = hit
        return hit

    def typed(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Of each word: the id it has alone, and the one it has behind the word before it."""
        alone = [self.token(w)[0] for w in words]
        behind = list(alone)
        for k in range(1, len(words)):
            if behind[k - 1] == _NUMBER and behind[k] != _NUMBER:
                behind[k] = _UNIT
        return alone, behind

    def __getstate__(self):
        return {"names": self.names, "units": self.units, "words": self.words, "lower": set(), "cache": {}}


_NUMBER, _NAME, _UNIT = _id(NUMBER), _id(NAME), _id(UNIT)
_SLOTS = np.array([_NUMBER, _NAME, _UNIT], np.uint64)
_SALT = np.uint64(_id("\0words"))


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = Templates(batch.column(0).to_pylist())
        # A name of one batch may be lower-case in another; both are needed to tell.
        pairs = [(w, kind) for kind in ("names", "units", "words", "lower") for w in getattr(t, kind)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([k for _, k in pairs], pa.string())], ["word", "kind"])


_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) for k in range(WINDOW)]


def _is_slot(ids: np.ndarray) -> np.ndarray:
    return (ids == _SLOTS[0]) | (ids == _SLOTS[1]) | (ids == _SLOTS[2])


def _window_hashes(alone: np.ndarray, behind: np.ndarray, words: list[str], templates: Templates) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of every WINDOW consecutive ids, the first typed alone, wrapping modulo 2^64, and whether it is one
    of the words themselves."""
    n = max(0, len(alone) - WINDOW + 1)
    out = alone[:n] * _POWERS[0]
    for k in range(1, WINDOW):
        out += behind[k : k + n] * _POWERS[k]
    literals = np.cumsum(np.r_[0, ~_is_slot(behind)])
    by_words = ~_is_slot(alone[:n]) + literals[WINDOW : WINDOW + n] - literals[1 : n + 1] < LITERAL_WORDS
    few = np.flatnonzero(by_words)
    if len(few):
        plain = np.zeros(len(words), np.uint64)
        for p in np.unique((few[:, None] + np.arange(WINDOW)).ravel()):
            plain[p] = templates.token(words[p])[1]
        out[few] = sum((plain[few + k] * _POWERS[k] for k in range(1, WINDOW)), plain[few] * _POWERS[0]) ^ _SALT
    return out, by_words


def _among(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes pass the filter, a bitmap over their lowest bits."""
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The filter of a table of windows: made in the tasks, at most MOST_BITS bits however many windows there are."""
    size = LEAST_BITS
    while size < min(MOST_BITS, BITS_PER_WINDOW * windows.count()):
        size *= 2
    place = windows.select(F.col("window").bitwiseAND(F.lit(size - 1)).alias("p"))
    rows = place.groupBy(F.shiftright("p", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(0x7FFF))).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        out[r["bucket"] << 12 : (r["bucket"] + 1) << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _windows(batches: Iterator[pa.RecordBatch], templates: Templates, wanted: np.ndarray | None, spoken: bool, named: list[int] = []) -> Iterator[pa.RecordBatch]:  # noqa: B006
    """(id, text) -> (id, window, slots, names: bits of the places of names); only windows that pass the filter
    ``wanted``, if given, as they are or once any word counts as a name in one of the sets of places ``named``."""
    for batch in batches:
        keys, alone, behind, words, owner = batch.column(0).to_pylist(), [], [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            found = tokens(speech(text) if spoken else text or "")
            if len(found) < WINDOW:
                continue
            a, b = templates.typed(found)
            alone += a
            behind += b
            words += found
            owner.append((row, len(found)))
        first, rest = np.array(alone, np.uint64), np.array(behind, np.uint64)
        hashes, by_words = _window_hashes(first, rest, words, templates)
        n = len(hashes)
        whose = np.repeat([r for r, _ in owner], [n for _, n in owner]) if owner else np.empty(0, np.int64)
        inside = whose[:n] == whose[WINDOW - 1 :][:n]
        hit = np.flatnonzero(inside if wanted is None else inside & _among(hashes, wanted))
        at, window = [hit], [hashes[hit]]
        forced = [0] * len(hit)
        if named and n:
            change = [(np.uint64(_NAME) - (rest if k else first)[k : k + n]) * _POWERS[k] for k in range(WINDOW)]
            for places in named:
                other = hashes.copy()
                for k in range(WINDOW):
                    if places >> k & 1:
                        other += change[k]
                hit = np.flatnonzero(inside & ~by_words & (other != hashes) & _among(other, wanted))
                at.append(hit)
                window.append(other[hit])
                forced += [places] * len(hit)
        at, slots, names = np.concatenate(at), [], []
        for p, places in zip(at, forced):
            kinds = [_NAME if places >> k & 1 else (behind if k else alone)[p + k] for k in range(WINDOW)]
            shown = [skeleton(words[p + k]) for k in range(WINDOW)]
            slots.append([s for s, i in zip(shown, kinds) if i in (_NUMBER, _NAME, _UNIT)])
            names.append(0 if by_words[p] else sum(1 << k for k, i in enumerate(kinds) if i == _NAME))
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[whose[p]] for p in at], batch.schema.field(0).type), pa.array(np.concatenate(window).view(np.int64)), pa.array(slots, pa.list_(pa.string())), pa.array(names, pa.int32())],
            ["id", "window", "slots", "names"],
        )


def template_matches(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, spoken: bool = True, any_name: bool = False) -> DataFrame:
    """doc_id, item_id, window, doc_slots, item_slots: windows of 12 template words that a document and an item share.

    One pass over the corpus, whatever the number of items: slots are learned from all items, a bitmap of the items'
    windows lets few others of the documents through, and these are joined by their hash. With ``any_name`` a document
    may have any word, ordinary ones too, where the item has a name, at the cost of one search for each of the different
    sets of places that names have in the items' windows. Null or short texts share nothing; repeated rows repeat
    theirs.
    """
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    corpus = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    templates = Templates.fitted(asked.select("text"))
    schema = "id {}, window long, slots array<string>, names int"
    item_windows = checkpointed(asked.mapInArrow(partial(_windows, templates=templates, wanted=None, spoken=False), schema.format(kinds[1])))
    wanted = _bitmap(item_windows.select("window").distinct())
    # At most 2 ** WINDOW sets of places.
    named = [r[0] for r in item_windows.where("names <> 0").select("names").distinct().collect()] if any_name else []
    found = corpus.mapInArrow(partial(_windows, templates=templates, wanted=wanted, spoken=spoken, named=named), schema.format(kinds[0]))
    out = found.select(F.col("id").alias("doc_id"), "window", F.col("slots").alias("doc_slots")).join(
        item_windows.select(F.col("id").alias("item_id"), "window", F.col("slots").alias("item_slots")), "window"
    )
    return out.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "window", "doc_slots", "item_slots")


def leaked(matches: DataFrame, doc_id: str, item_id: str) -> DataFrame:
    """doc_id, item_id of documents that hold 12 or more consecutive words of an item: a window with equal slots."""
    return matches.where("doc_slots = item_slots").select(doc_id, item_id).distinct()


def reparameterised(matches: DataFrame, doc_id: str, item_id: str) -> DataFrame:
    """doc_id, item_id, windows: the item's template with other values, each value replaced by one and the same."""
    other = matches.where("doc_slots <> item_slots and size(doc_slots) = size(item_slots)")
    slots = other.select(doc_id, item_id, "window", F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("s"))
    per = slots.groupBy(doc_id, item_id).agg(
        F.count_distinct("window").alias("windows"),
        F.count_distinct("s").alias("pairs"),
        F.count_distinct("s.item_slots").alias("from"),
        F.count_distinct("s.doc_slots").alias("to"),
    )
    consistent = per.where("pairs = `from` and pairs = `to`").select(doc_id, item_id, "windows")
    return consistent.join(leaked(matches, doc_id, item_id), [doc_id, item_id], "left_anti")
