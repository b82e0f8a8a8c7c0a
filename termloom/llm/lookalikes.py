"""One form for texts that look the same but differ in characters.

Plain tokens of the collection form vocabulary tries. A token with odd characters runs through its trie as a weighted
edit automaton in which look-alikes and ignorables cost nothing; the most frequent spelling it reaches is its canonical
one. Tokens that reach none are normalised by table. Width of letters, kind of blank, ligatures and composition are no
visible difference; case, accents, punctuation and the number of blanks are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters of other scripts and the Latin letters they look like (fixed values).
CYRILLIC = ("аеорсухіјѕһԁԛԝӏгАВЕЅІЈКМНОРСТУХҮԌԚԜӀЗ", "aeopcyxijshdqwlrABESIJKMHOPCTYXYGQWI3")
GREEK = ("ανορυικχτϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "avopuikxtcjABEZHIKMNOPTYXCJ")
ARMENIAN = ("օսոհցքԼՏՕՍ", "ounhgpLSOU")
CHEROKEE = ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏔᏙᏚᏞᏟᏢᏦᏒᏴ", "DRTAJEWMHGZ4WVSLCPKRB")
OTHER = ("ıȷɡɑᴏᴄᴠᴡᴢꞌ", "ijgaocvwz'")
LOOKALIKES = {a: b for odd, plain in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, OTHER) for a, b in zip(odd, plain, strict=True)}
#: What a letter may be as well, if that makes a word of the collection and the letter above doesn't (fixed values).
ALSO = {"І": "l", "Ӏ": "l", "ӏ": "I", "Ι": "l", "О": "0", "Ο": "0", "Օ": "0"}
#: Plain letters that such a letter can't tell apart, and the one that stands for both in a shard's key.
FOLDED = ("l0", "IO")
#: Cost of the second reading of a letter, of any other edit, and the most that a canonical spelling may cost.
SECOND, EDIT, BUDGET = 0.25, 1.0, 0.5
#: Characters that print nothing.
_IGNORABLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")
#: Blanks of all kinds, as a Java and a Python character class.
BLANKS = "[ \t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"
_BLANK = re.compile(BLANKS)


@lru_cache(100_000)
def _readings(char: str) -> tuple[tuple[str, float], ...]:
    """What a character shows, decomposed, each with its cost: in plain width, as Latin where it looks Latin, '' if it
    prints nothing. The first reading is the table's."""
    if _IGNORABLE.match(char):
        return (("", 0.0),)
    if _BLANK.match(char):
        return ((" ", 0.0),)
    if unicodedata.decomposition(char).startswith(("<wide>", "<narrow>")) or "\ufb00" <= char <= "\ufb06" or "\U0001d400" <= char <= "\U0001d7ff":
        char = unicodedata.normalize("NFKC", char)
    plain = "".join(LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFD", char))
    return ((plain, 0.0), (ALSO[char], SECOND)) if char in ALSO else ((plain, 0.0),)


def by_table(text: str) -> str:
    """The text in canonical characters."""
    if text.isascii():
        return text.replace("\t", " ")
    return unicodedata.normalize("NFC", "".join(_readings(c)[0][0] for c in text))


class Trie:
    """Vocabulary trie over visible characters."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", word):
            node = node.setdefault(c, {})
        best = node.get("")
        if best is None or (-best[1], best[0]) > (-count, word):
            node[""] = (word, count)

    def match(self, token: str, budget: float = BUDGET, edit: float = EDIT) -> str | None:
        """The spelling reached at the least cost within ``budget`` (ties: most frequent, then smallest). Look-alikes and
        ignorables cost 0, the second reading of a letter SECOND, any other substitution, insertion or deletion
        ``edit``."""
        states = self._closed([(0.0, self.root)], budget, edit)
        for char in unicodedata.normalize("NFD", token):
            reached = []
            for shown, price in _readings(char):
                if not shown:
                    reached = states
                for cost, node in states if shown else ():
                    cost += price
                    for c in shown:
                        node = node.get(c)
                        if node is None:
                            break
                    else:
                        if cost <= budget:
                            reached.append((cost, node))
            if edit <= budget and _readings(char)[0][0]:
                for cost, node in states:
                    if cost + edit <= budget:
                        reached.append((cost + edit, node))
                        reached += [(cost + edit, n) for k, n in node.items() if k and k != char]
            states = self._closed(reached, budget, edit)
            if not states:
                return None
        ends = [(cost, -node[""][1], node[""][0]) for cost, node in states if "" in node]
        return min(ends)[2] if ends else None

    @staticmethod
    def _closed(states: list, budget: float, edit: float) -> list:
        """The least cost of each node, with those reached by leaving out letters of the vocabulary."""
        best: dict[int, tuple] = {}
        states = list(states)
        while states:
            cost, node = states.pop()
            if id(node) not in best or cost < best[id(node)][0]:
                best[id(node)] = (cost, node)
                if cost + edit <= budget:
                    states += [(cost + edit, n) for k, n in node.items() if k]
        return list(best.values())


@F.pandas_udf(StringType())
def _table_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else by_table(t))


def _match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards come one after the other; the plain tokens of each come first and build its trie, the only one in memory."""
    shard, trie = None, Trie()
    for frame in frames:
        out = []
        for token, shown, n, a, b, odd in zip(frame["token"], frame["shown"], frame["n"], frame["start"], frame["length"], frame["odd"]):
            if (a, b) != shard:
                shard, trie = (a, b), Trie()
            if not odd:
                trie.add(token, n)
            else:
                out.append((token, trie.match(token) or shown))
        if out:
            yield pd.DataFrame(out, columns=["token", "canonical"])


def canonical_tokens(tokens: DataFrame) -> DataFrame:
    """token, canonical for the odd ones of ``tokens`` (token, n). A shard of the vocabulary is what begins with the same
    two visible characters, letters that can't be told apart taken for one, and has the same visible length; shards
    without odd tokens are not built."""
    ascii_only = F.col("token").rlike(r"^[\x20-\x7E]*$")
    shown = tokens.where(~ascii_only).withColumn("shown", _table_udf("token")).unionByName(tokens.where(ascii_only).withColumn("shown", F.col("token")))
    start = F.translate(F.substring("shown", 1, 2), *FOLDED)
    keyed = shown.select("token", "n", "shown", start.alias("start"), F.length("shown").alias("length"), (F.col("shown") != F.col("token")).alias("odd"))
    wanted = keyed.where("odd").select("start", "length").distinct()
    kept = keyed.join(wanted, ["start", "length"], "left_semi")
    return kept.repartition("start", "length").sortWithinPartitions("start", "length", "odd").mapInPandas(_match, "token string, canonical string")


def canonical_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """text, canonical for every distinct text that is not its own canonical form. Nulls have none; empty is itself."""
    distinct = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    split = lambda c: F.split(c, BLANKS, -1)
    tokens = distinct.select(F.explode(split(F.col("text"))).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
    mapping = canonical_tokens(tokens)
    placed = distinct.where(~F.col("text").rlike(r"^[\x20-\x7E]*$")).select("text", F.posexplode(split(F.col("text"))).alias("pos", "token"))
    spelled = placed.join(mapping, "token", "left").withColumn("new", F.coalesce("canonical", "token"))
    joined = spelled.groupBy("text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda s: s["new"]), " ").alias("canonical"))
    return joined.where("canonical <> text")


def lookalike_classes(rows: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """group, key, class_key, n_texts: rows whose text looks like another text of their group, with the smallest key of
    their class and its number of different texts. Copies are members of their class, never pairs."""
    rows = rows.where(F.col(text).isNotNull()).select(F.col(group).alias("grp"), F.col(key).alias("key"), F.col(text).alias("text"))
    texts = rows.groupBy("grp", "text").agg(F.min("key").alias("least")).join(canonical_texts(rows), "text", "left")
    texts = texts.select("grp", "text", "least", F.coalesce("canonical", "text").alias("canonical"))
    classes = texts.groupBy("grp", "canonical").agg(F.min("least").alias("class_key"), F.count("*").alias("n_texts")).where("n_texts > 1")
    members = texts.join(classes, ["grp", "canonical"]).select("grp", "text", "class_key", "n_texts")
    return rows.join(members, ["grp", "text"]).select(F.col("grp").alias(group), F.col("key").alias(key), "class_key", "n_texts")


def lookalike_pairs(rows: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """group, key_a, key_b: rows of one group whose texts look the same and differ in characters, key_a < key_b.

    Every odd row meets the rows with its canonical text, so groups of equal texts are never paired with themselves.
    """
    rows = rows.where(F.col(text).isNotNull()).select(F.col(group).alias("grp"), F.col(key).alias("key"), F.col(text).alias("text"))
    forms = canonical_texts(rows)
    odd = rows.join(forms, "text").select("grp", F.col("key").alias("k"), F.col("text").alias("t"), "canonical")
    plain = rows.select("grp", F.col("key").alias("other"), F.col("text").alias("canonical"))
    from_odd = odd.select("grp", F.col("k").alias("other"), F.col("t").alias("other_text"), "canonical")
    with_plain = odd.join(plain, ["grp", "canonical"]).select("grp", "k", "other")
    with_odd = odd.join(from_odd, ["grp", "canonical"]).where("k < other and t <> other_text").select("grp", "k", "other")
    # A row whose canonical form is plain text can't be plain itself, so the two parts share no pair.
    pairs = with_plain.unionByName(with_odd)
    return pairs.select(F.col("grp").alias(group), F.least("k", "other").alias("key_a"), F.greatest("k", "other").alias("key_b")).where("key_a < key_b")
