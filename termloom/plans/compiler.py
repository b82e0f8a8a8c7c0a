"""Query trees to lazy DataFrames.

Results: scored (doc_id, score), unscored (doc_id), raw (context, doc_id, words, score, positions), words (word, score).
Leaves filter the postings on pushed-down predicates; an n-ary AND or OR is one union and one aggregation on doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.fuzzy import ENGLISH, FuzzyConfig, fuzz
from termloom.operators.context_types import ContextSchema
from termloom.plans import query as Q


class QueryError(Exception):
    """A failed command or query with a code."""

    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code, self.message = code, message


@dataclass(frozen=True)
class ProcessConfig:
    """``doc_limit``: words of one lookup in one context are taken in index order until they have so many documents (0:
    all). ``strict_boost``: boosts inside positional operators multiply instead of being a lower bound.
    ``expand_fuzzy``: fuzzy words also find their cheap respellings."""

    doc_limit: int = 500
    strict_boost: bool = False
    expand_fuzzy: bool = False
    fuzzy: FuzzyConfig = field(default_factory=lambda: FuzzyConfig(most=0.5, pairs=ENGLISH))


class Compiler:
    def __init__(self, postings: DataFrame, schemas: dict[str, ContextSchema], config: ProcessConfig = ProcessConfig()) -> None:
        self.postings, self.schemas, self.config = postings, schemas, config

    # -- contexts

    def default_contexts(self) -> list[str]:
        return [n for n, s in self.schemas.items() if s.default]

    def _known(self, contexts) -> list[str]:
        missing = [c for c in contexts if c not in self.schemas]
        if missing:
            raise QueryError(404, f"mentioned context(s) are not present: {', '.join(missing)}")
        return list(contexts)

    def _weight(self, contexts: list[str]) -> Column:
        pairs = [x for c in contexts for x in (F.lit(c), F.lit(float(self.schemas[c].weight)))]
        return F.create_map(*pairs)[F.col("context")] if pairs else F.lit(1.0)

    # -- leaves

    def _leaf(self, q: Q.Query, contexts: list[str]) -> DataFrame:
        """context, word, doc_id, positions, tf, sim of one primary query."""
        groups: dict[tuple, list[str]] = {}
        plans: dict[tuple, tuple[Column, Column]] = {}
        for c in contexts:
            s = self.schemas[c]
            found = self._range(q, s) if isinstance(q, Q.Range) else self._word(q, s)
            if found is not None:
                key, predicate, sim = found
                groups.setdefault(key, []).append(c)
                plans[key] = (predicate, sim)
        parts = []
        for key, names in groups.items():
            predicate, sim = plans[key]
            hits = self.postings.where(F.col("context").isin(names) & predicate)
            parts.append(hits.select("context", "word", "doc_id", "positions", "tf", sim.cast("double").alias("sim")))
        if not parts:
            return self.postings.where("false").select("context", "word", "doc_id", "positions", "tf", F.lit(0.0).alias("sim"))
        return self._limited(reduce(DataFrame.unionByName, parts), in_key_order=isinstance(q, Q.Range))

    def _word(self, q: Q.Word | Q.FullWord, s: ContextSchema):
        w = s.normal_word(q.text)
        key = s.kind.parse(w)
        if key is None:
            return None
        if s.kind.equals is not None:
            return (s.type, key), s.kind.equals(key), s.kind.score(key)
        lower = w.lower()
        full = isinstance(q, Q.FullWord)
        if q.mode == Q.CASE:
            predicate = F.col("word") == w if full else F.col("word").startswith(w)
        else:
            predicate = F.col("word_lc") == lower if full else F.col("word_lc").startswith(lower)
            if q.mode == Q.FUZZY and self.config.expand_fuzzy:
                forms = [lower, *fuzz(lower, self.config.fuzzy)]
                predicate = F.col("word_lc").isin(forms) if full else reduce(Column.__or__, [F.col("word_lc").startswith(f) for f in forms])
        return (s.kind.name, w), predicate, s.kind.score(w)

    def _range(self, q: Q.Range, s: ContextSchema):
        a, b = (s.kind.parse(s.normal_word(x)) for x in (q.lower, q.upper))
        if a is None or b is None:
            return None
        return (s.kind.name, a, b), s.kind.between(a, b), s.kind.range_score(a, b)

    def _limited(self, hits: DataFrame, in_key_order: bool) -> DataFrame:
        limit = self.config.doc_limit
        if not limit:
            return hits
        # A word has a document at least, so the first ``limit`` words decide; ranking cuts before the running sum.
        order = ["word"] if in_key_order else [F.length("word"), F.col("word")]
        per_word = hits.groupBy("context", "word").agg(F.count("*").alias("df"))
        first = per_word.withColumn("rank", F.row_number().over(Window.partitionBy("context").orderBy(*order))).where(F.col("rank") <= limit)
        before = F.sum("df").over(Window.partitionBy("context").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
        kept = first.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < limit).select("context", "word")
        return hits.join(F.broadcast(kept), ["context", "word"], "left_semi")  # at most limit words per context

    # -- evaluators

    def scored(self, q: Q.Query, contexts: list[str] | None = None) -> DataFrame:
        """doc_id, score."""
        return self._scored(Q.normal_form(q), self.default_contexts() if contexts is None else contexts)

    def _scored(self, q: Q.Query, contexts: list[str]) -> DataFrame:
        match q:
            case Q.Word() | Q.FullWord() | Q.Range():
                hits = self._leaf(q, contexts)
                return hits.groupBy("doc_id").agg(F.max(self._weight(contexts) * F.col("sim") * F.col("tf")).alias("score"))
            case Q.InContexts(names, inner):
                return self._scored(inner, self._known(names))
            case Q.Boost(weight, inner):
                return self._scored(inner, contexts).select("doc_id", (F.col("score") * float(weight)).alias("score"))
            case Q.Seq(op, args) if op.positional:
                raw = self._raw(q, contexts)
                total = self._weight(contexts) * F.col("score") * F.coalesce(F.size("positions"), F.lit(1))
                return raw.groupBy("doc_id").agg(F.max(total).alias("score"))
            case Q.Seq(op, args) if op.name == Q.ANDNOT:
                first = self._scored(args[0], contexts)
                return reduce(lambda l, a: l.join(self._unscored(a, contexts), "doc_id", "left_anti"), args[1:], first)
            case Q.Seq(op, args):
                branches = reduce(DataFrame.unionByName, [self._scored(a, contexts) for a in args])
                if op.name == Q.OR:
                    return branches.groupBy("doc_id").agg(F.max("score").alias("score"))
                both = branches.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
                return both.where(F.col("n") == len(args)).select("doc_id", "score")
        raise QueryError(400, f"query can't be evaluated: {q}")

    def unscored(self, q: Q.Query, contexts: list[str] | None = None) -> DataFrame:
        """doc_id, without repetition."""
        return self._unscored(Q.normal_form(q), self.default_contexts() if contexts is None else contexts)

    def _unscored(self, q: Q.Query, contexts: list[str]) -> DataFrame:
        match q:
            case Q.Word() | Q.FullWord() | Q.Range():
                return self._leaf(q, contexts).select("doc_id").distinct()
            case Q.InContexts(names, inner):
                return self._unscored(inner, self._known(names))
            case Q.Boost(_, inner):
                return self._unscored(inner, contexts)
            case Q.Seq(op, args) if op.positional:
                return self._raw(q, contexts).select("doc_id").distinct()
            case Q.Seq(op, args) if op.name == Q.ANDNOT:
                first = self._unscored(args[0], contexts)
                return reduce(lambda l, a: l.join(self._unscored(a, contexts), "doc_id", "left_anti"), args[1:], first)
            case Q.Seq(op, args):
                branches = reduce(DataFrame.unionByName, [self._unscored(a, contexts) for a in args])
                if op.name == Q.OR:
                    return branches.distinct()
                return branches.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(args)).select("doc_id")
        raise QueryError(400, f"query can't be evaluated: {q}")

    def raw(self, q: Q.Query, contexts: list[str] | None = None) -> DataFrame:
        return self._raw(Q.normal_form(q), self.default_contexts() if contexts is None else contexts)

    def _raw(self, q: Q.Query, contexts: list[str]) -> DataFrame:
        """context, doc_id, words, score, positions: one row per combination of words and document."""
        match q:
            case Q.Word() | Q.FullWord() | Q.Range():
                hits = self._leaf(q, contexts).where("sim > 0")
                return hits.select("context", "doc_id", F.array("word").alias("words"), F.col("sim").alias("score"), "positions")
            case Q.InContexts(names, inner):
                return self._raw(inner, [c for c in contexts if c in self._known(names)])
            case Q.Boost(weight, inner):
                score = F.col("score") * float(weight) if self.config.strict_boost else F.greatest("score", F.lit(float(weight)))
                return self._raw(inner, contexts).withColumn("score", score)
            case Q.Seq(op, args):
                first, *others = args
                out = self._raw(first, contexts)
                for k, a in enumerate(others, 1):
                    out = self._combined(out, self._raw(a, contexts), op, k)
                return out
        raise QueryError(400, f"query can't be evaluated: {q}")

    def _combined(self, left: DataFrame, right: DataFrame, op: Q.Op, k: int) -> DataFrame:
        keys = ["context", "doc_id"]
        if op.name == Q.OR:
            return left.unionByName(right)
        if op.name == Q.ANDNOT:
            return left.join(right.select(*keys).distinct(), keys, "left_anti")
        r = right.select(*keys, F.col("words").alias("r_words"), F.col("score").alias("r_score"), F.col("positions").alias("r_positions"))
        p, q = F.col("positions"), F.col("r_positions")
        if op.name == Q.AND:
            kept = F.coalesce(F.array_sort(F.array_union(p, q)), p, q)
        elif op.name == Q.PHRASE:
            kept = F.filter(p, lambda x: F.array_contains(q, x + k))
        else:
            low, high = (1 if op.name == "follow" else -k * op.distance), k * op.distance
            kept = F.filter(p, lambda x: F.exists(q, lambda y: (y - x).between(low, high)))
        joined = left.join(r, keys)
        # Types without positions only intersect.
        positions = F.when(p.isNotNull() & q.isNotNull(), kept).otherwise(F.coalesce(p, q) if op.name == Q.AND else p)
        combined = joined.select(*keys, F.concat("words", "r_words").alias("words"), (F.col("score") + F.col("r_score")).alias("score"), positions.alias("positions"))
        return combined.where(F.col("positions").isNull() | (F.size("positions") > 0))

    def completions(self, q: Q.Query, contexts: list[str] | None = None) -> DataFrame:
        """word, score: words that the last word of the query may go on to."""
        return self._words(Q.completion_form(q), self.default_contexts() if contexts is None else contexts)

    def _words(self, q: Q.Query, contexts: list[str], within: DataFrame | None = None) -> DataFrame:
        match q:
            case Q.InContexts(names, inner):
                return self._words(inner, self._known(names), within)
            case Q.Boost(weight, inner):
                return self._words(inner, contexts, within).withColumn("score", F.col("score") * float(weight))
            case Q.Seq(op, args) if op.name in (Q.OR, Q.ANDNOT):
                return self._words(args[-1], contexts, within)
            case Q.Seq(op, args) if op.name == Q.AND:
                others = self._unscored(Q.ands(args[:-1]), contexts)
                return self._words(args[-1], contexts, others if within is None else within.join(others, "doc_id", "left_semi"))
        raw = self._raw(q, contexts)
        if within is not None:
            raw = raw.join(within, "doc_id", "left_semi")
        tf = F.coalesce(F.size("positions"), F.lit(1))
        per_words = raw.groupBy("context", "words").agg(F.greatest(F.lit(1.0), F.max(F.col("score") * tf)).alias("score"))
        per_word = per_words.groupBy("context", F.element_at("words", -1).alias("word")).agg(F.sum("score").alias("score"))
        return per_word.groupBy("word").agg(F.max(self._weight(contexts) * F.col("score")).alias("score"))
