"""Query trees: nodes, builders, JSON form, text form and rewrites. Driver-side only."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

CASE, NOCASE, FUZZY = "case", "nocase", "fuzzy"
AND, OR, ANDNOT, PHRASE = "and", "or", "and not", "phrase"


@dataclass(frozen=True)
class Op:
    """and, or, and not, phrase, follow n, near n."""

    name: str
    distance: int = 0

    def __str__(self) -> str:
        return f"{self.name} {self.distance}" if self.name in ("follow", "near") else self.name

    @property
    def positional(self) -> bool:
        return self.name in (PHRASE, "follow", "near")

    @classmethod
    def of(cls, text: str) -> Op:
        words = text.split()
        if len(words) == 2 and words[0] in ("follow", "near"):
            return cls(words[0], int(words[1]))
        if text in (AND, OR, ANDNOT, PHRASE):
            return cls(text)
        raise ValueError(f"no operator: {text}")


class Query:
    """Base of all nodes."""


@dataclass(frozen=True)
class Word(Query):
    """Prefix search."""

    text: str
    mode: str = NOCASE


@dataclass(frozen=True)
class FullWord(Query):
    text: str
    mode: str = NOCASE


@dataclass(frozen=True)
class Phrase(Query):
    """Words in a row, blank-separated."""

    text: str
    mode: str = NOCASE


@dataclass(frozen=True)
class InContexts(Query):
    contexts: tuple[str, ...]
    query: Query


@dataclass(frozen=True)
class Binary(Query):
    op: Op
    left: Query
    right: Query


@dataclass(frozen=True)
class Seq(Query):
    op: Op
    args: tuple[Query, ...]


@dataclass(frozen=True)
class Boost(Query):
    weight: float
    query: Query


@dataclass(frozen=True)
class Range(Query):
    lower: str
    upper: str


# ---------------------------------------------------------------- builders


def word(text: str) -> Query:
    return Word(text, CASE)


def word_nocase(text: str) -> Query:
    return Word(text)


def full_word(text: str) -> Query:
    return FullWord(text, CASE)


def full_word_nocase(text: str) -> Query:
    return FullWord(text)


def phrase(text: str) -> Query:
    return _phrase(text, CASE)


def phrase_nocase(text: str) -> Query:
    return _phrase(text, NOCASE)


def _phrase(text: str, mode: str) -> Query:
    return nexts([FullWord(w, mode) for w in text.split()])


def prefix_phrase(text: str, mode: str = NOCASE) -> Query:
    return nexts([Word(w, mode) for w in text.split()])


def range_of(lower: str, upper: str) -> Query:
    return Range(lower, upper)


def _seq(op: Op, args: Iterable[Query]) -> Query:
    """Arguments with the same associative operator are spliced in, one level; a single one stands for itself."""
    flat: list[Query] = []
    for a in args:
        if isinstance(a, Seq) and a.op == op and op.name in (AND, OR, PHRASE):
            flat += a.args
        else:
            flat.append(a)
    return flat[0] if len(flat) == 1 else Seq(op, tuple(flat))


def ands(args: Iterable[Query]) -> Query:
    return _seq(Op(AND), args)


def ors(args: Iterable[Query]) -> Query:
    return _seq(Op(OR), args)


def and_nots(args: Iterable[Query]) -> Query:
    args = list(args)
    first = args[0]
    if isinstance(first, Seq) and first.op.name == ANDNOT:  # left-associative
        args = [*first.args, *args[1:]]
    return args[0] if len(args) == 1 else Seq(Op(ANDNOT), tuple(args))


def nexts(args: Iterable[Query]) -> Query:
    return _seq(Op(PHRASE), args)


def follows(distance: int, args: Iterable[Query]) -> Query:
    return _seq(Op("follow", distance), args)


def nears(distance: int, args: Iterable[Query]) -> Query:
    return _seq(Op("near", distance), args)


def in_contexts(contexts: Iterable[str], query: Query) -> Query:
    return InContexts(tuple(contexts), query)


def boosted(weight: float, query: Query) -> Query:
    return Boost(weight, query)


def with_mode(mode: str, query: Query) -> Query:
    """Search mode of a single word or phrase node; sequences stay as they are."""
    return replace(query, mode=mode) if isinstance(query, (Word, FullWord, Phrase)) else query


def fuzzy(query: Query) -> Query:
    return with_mode(FUZZY, query)


def no_case(query: Query) -> Query:
    return with_mode(NOCASE, query)


# ---------------------------------------------------------------- JSON form


def to_json(q: Query) -> dict:
    match q:
        case Word(text, mode):
            return {"type": "word", "op": mode, "word": text}
        case FullWord(text, mode):
            return {"type": "fullword", "op": mode, "word": text}
        case Phrase(text, mode):
            return {"type": "phrase", "op": mode, "phrase": text}
        case InContexts(contexts, inner):
            return {"type": "context", "contexts": list(contexts), "query": to_json(inner)}
        case Binary(op, left, right):
            return {"type": str(op), "query1": to_json(left), "query2": to_json(right)}
        case Seq(op, args):
            return {"type": "seq", "op": str(op), "args": [to_json(a) for a in args]}
        case Boost(weight, inner):
            return {"type": "boost", "weight": weight, "query": to_json(inner)}
        case Range(lower, upper):
            return {"type": "range", "lower": lower, "upper": upper}
    raise TypeError(q)


def from_json(o: dict) -> Query:
    """All tags of to_json; binary nodes may carry any operator as their tag."""
    kind = o["type"]
    match kind:
        case "word":
            return Word(o["word"], o["op"])
        case "fullword":
            return FullWord(o["word"], o["op"])
        case "phrase" if "phrase" in o:
            return Phrase(o["phrase"], o["op"])
        case "context":
            return InContexts(tuple(o["contexts"]), from_json(o["query"]))
        case "boost":
            return Boost(float(o["weight"]), from_json(o["query"]))
        case "range":
            return Range(o["lower"], o["upper"])
        case "seq":
            return Seq(Op.of(o["op"]), tuple(from_json(a) for a in o["args"]))
    return Binary(Op.of(kind), from_json(o["query1"]), from_json(o["query2"]))


# ---------------------------------------------------------------- text form

SPECIAL = "\\\"')([]^ \n\r\t"
RESERVED = ("OR", "AND", "++", "NEAR", "FOLLOW")


def _escape(text: str) -> str:
    shown = "".join(f"\\{c}" if c in SPECIAL else c for c in text)
    return f"'{text}'" if text in RESERVED or (text.startswith(("!", "~")) and "'" not in text) or ":" in text and "'" not in text else shown


def _quoted(text: str) -> str:
    return '"' + text.replace('"', '\\"') + '"'


_INFIX = {AND: " AND ", OR: " OR ", ANDNOT: " AND NOT ", PHRASE: " ++ "}


def show(q: Query) -> str:
    """Text of the query language that parses to an equal tree."""
    match q:
        case Word(text, mode):
            return {CASE: "!", FUZZY: "~", NOCASE: ""}[mode] + _escape(text)
        case FullWord(text, mode) | Phrase(text, mode):
            return {CASE: "!", FUZZY: "", NOCASE: ""}[mode] + _quoted(text)
        case InContexts(contexts, inner):
            return f"{','.join(contexts)}:({show(inner)})"
        case Boost(weight, inner):
            return f"({show(inner)})^{weight:g}"
        case Range(lower, upper):
            return f"[{_escape(lower)} TO {_escape(upper)}]"
        case Binary(op, left, right):
            return show(Seq(op, (left, right)))
        case Seq(op, args):
            infix = _INFIX.get(op.name) or f" {op.name.upper()} {op.distance} "
            return "(" + infix.join(show(a) if not isinstance(a, Seq) else show(a) for a in args) + ")"
    raise TypeError(q)


# ---------------------------------------------------------------- rewrites and folds


def normal_form(q: Query) -> Query:
    """Phrases become sequences of full words (one word: a full word), binaries flat sequences."""
    match q:
        case Phrase(text, mode):
            words = tuple(FullWord(w, mode) for w in text.split())
            return words[0] if len(words) == 1 else Seq(Op(PHRASE), words)
        case Binary(op, left, right):
            args = [normal_form(left), normal_form(right)]
            return and_nots(args) if op.name == ANDNOT else _seq(op, args)
        case Seq(op, args):
            args = [normal_form(a) for a in args]
            return and_nots(args) if op.name == ANDNOT else _seq(op, args)
        case InContexts(contexts, inner):
            return InContexts(contexts, normal_form(inner))
        case Boost(weight, inner):
            return normal_form(inner) if weight == 1.0 else Boost(weight, normal_form(inner))
    return q


def completion_form(q: Query) -> Query:
    """normal_form in which the last word of a phrase node is a prefix."""
    if isinstance(q, Phrase):
        words = q.text.split()
        args = (*(FullWord(w, q.mode) for w in words[:-1]), *(Word(w, q.mode) for w in words[-1:]))
        return args[0] if len(args) == 1 else Seq(Op(PHRASE), args)
    if isinstance(q, (InContexts, Boost)):
        return replace(q, query=completion_form(q.query))
    if isinstance(q, Binary):
        return normal_form(Binary(q.op, q.left, completion_form(q.right)))
    if isinstance(q, Seq) and q.args:
        return normal_form(Seq(q.op, (*q.args[:-1], completion_form(q.args[-1]))))
    return normal_form(q)


def subsume_prefixes(q: Query) -> Query:
    """Opt-in: of two prefixes in one binary node the longer decides an AND, the shorter an OR. Changes scores."""
    if isinstance(q, Binary):
        left, right = subsume_prefixes(q.left), subsume_prefixes(q.right)
        if isinstance(left, Word) and isinstance(right, Word) and left.mode == right.mode and q.op.name in (AND, OR):
            fold = str.lower if left.mode != CASE else str
            a, b = fold(left.text), fold(right.text)
            if a.startswith(b):
                return left if q.op.name == AND else right
            if b.startswith(a):
                return right if q.op.name == AND else left
        return Binary(q.op, left, right)
    if isinstance(q, (InContexts, Boost)):
        return replace(q, query=subsume_prefixes(q.query))
    if isinstance(q, Seq):
        return Seq(q.op, tuple(map(subsume_prefixes, q.args)))
    return q


def terms(q: Query) -> list[str]:
    """All query words, in order."""
    match q:
        case Word(text, _) | FullWord(text, _):
            return [text]
        case Phrase(text, _):
            return text.split()
        case InContexts(_, inner) | Boost(_, inner):
            return terms(inner)
        case Binary(_, left, right):
            return terms(left) + terms(right)
        case Seq(_, args):
            return [t for a in args for t in terms(a)]
        case Range(lower, upper):
            return [lower, upper]
    return []


def mentioned_contexts(q: Query) -> set[str]:
    """Contexts named anywhere in the query."""
    match q:
        case InContexts(contexts, inner):
            return set(contexts) | mentioned_contexts(inner)
        case Boost(_, inner):
            return mentioned_contexts(inner)
        case Binary(_, left, right):
            return mentioned_contexts(left) | mentioned_contexts(right)
        case Seq(_, args):
            return set().union(*map(mentioned_contexts, args))
    return set()


def check_with(predicate: Callable[[str], bool], q: Query) -> bool:
    """Whether all query words satisfy the predicate."""
    return all(map(predicate, terms(q)))


def complete_queries(q: Query, completions: Iterable[str]) -> list[Query]:
    """The query once per completion, put in place of its last word."""

    def put(q: Query, text: str) -> Query:
        match q:
            case Word() | FullWord():
                return replace(q, text=text)
            case Phrase(old, mode):
                return Phrase(" ".join([*old.split()[:-1], text]), mode)
            case InContexts() | Boost():
                return replace(q, query=put(q.query, text))
            case Binary(op, left, right):
                return Binary(op, left, put(right, text))
            case Seq(op, args) if args:
                return Seq(op, (*args[:-1], put(args[-1], text)))
        return q

    return [put(q, c) for c in completions]
