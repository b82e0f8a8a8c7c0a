"""Context types: how the text of a context becomes keys, how keys are found, compared and scored.

Types are registered by name; callers add their own with ``register_type``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions import normalize as N
from termloom.functions import similarity as S



@dataclass(frozen=True)
class ContextType:
    """``columns``: typed key columns of the postings; ``parse``: a query word as a typed value, None if invalid;
    ``equals`` / ``between``: predicates over the postings; ``score`` / ``range_score``: similarity of a hit."""

    name: str
    regexp: str
    valid: Callable[[Column], Column]
    positions: bool
    columns: Callable[[Column], dict[str, Column]] = lambda word: {}
    parse: Callable[[str], object | None] = lambda word: word or None
    equals: Callable[[object], Column] | None = None
    between: Callable[[object, object], Column] = lambda a, b: F.col("word").between(a, b)
    score: Callable[[object], Column] = S.default_similarity
    range_score: Callable[[object, object], Column] = lambda a, b: F.lit(1.0)


#: Default patterns (fixed values of the data model).
TEXT_RE = r"\w*"
INT_RE = "([-]?[0-9]*)"
DATE_RE = "[0-9]{4}-((0[1-9])|(1[0-2]))-((0[1-9])|([12][0-9])|(3[01]))"
POSITION_RE = r"-?(90(\.0*)?|[1-8]?[0-9](\.[0-9]*)?)--?((180(\.0*)?)|(1[0-7][0-9])|([1-9]?[0-9]))(\.[0-9]*)?"


def parse_int(word: str) -> int | None:
    body = word[1:] if word[:1] in ("+", "-") else word
    if not (body.isascii() and body.isdigit()):
        return None
    value = int(word)
    return value if -(2**63) <= value < 2**63 else None


def parse_date(word: str) -> datetime | None:
    """A driver-side twin of functions.normalize.date_key for one query word."""
    import re

    for pattern, groups in N.DATE_SHAPES.values():
        m = re.fullmatch(pattern.strip("^$"), word)
        if not m:
            continue
        year, month, day = (int(m[g]) if g else 1 for g in groups[:3])
        time = m[groups[3]] if groups[3] else "00:00:00"
        last = (datetime(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)).day if 0 < year < 9999 else 28
        if not 0 < year <= 9999:
            return None
        hour, minute, second = time.split(":")
        at = datetime(year, month, min(day, last), int(hour), int(minute), int(float(second)), int(round(float(second) % 1 * 1e6)))
        zone = m[groups[4]] if groups[4] else None
        if zone and zone != "Z":
            at -= (1 if zone[0] == "+" else -1) * timedelta(hours=int(zone[1:3]), minutes=int(zone[4:6]))
        return at
    return None


def parse_position(word: str) -> tuple[float, float] | None:
    import re

    m = re.fullmatch(N._POSITION.strip("^$"), word)
    if not m:
        return None
    lat, lon = float(m[1]), float(m[2])
    return (round(lat, 7), round(lon, 7)) if abs(lat) < 90 and abs(lon) < 180 else None


def _timestamp(at: datetime) -> Column:
    return F.lit(at.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def _box(a: tuple[float, float], b: tuple[float, float], ordered: bool) -> Column:
    (lat1, lon1), (lat2, lon2) = a, b
    if not ordered:
        lat1, lat2, lon1, lon2 = min(lat1, lat2), max(lat1, lat2), min(lon1, lon2), max(lon1, lon2)
    return F.col("lat").between(lat1, lat2) & F.col("lon").between(lon1, lon2)


def _position(name: str, ordered: bool) -> ContextType:
    return ContextType(
        name, POSITION_RE, N.is_position, False,
        columns=lambda w: {"lat": N.latitude(w), "lon": N.longitude(w)},
        parse=parse_position,
        equals=lambda p: (F.col("lat") == p[0]) & (F.col("lon") == p[1]),
        between=lambda a, b: _box(a, b, ordered),
    )


TYPES: dict[str, ContextType] = {
    "text": ContextType("text", TEXT_RE, lambda w: w != "", True, score=lambda k: S.similar(k, F.col("word"))),
    "text-small": ContextType("text-small", TEXT_RE, lambda w: w != "", False, score=lambda k: S.similar(k, F.col("word"))),
    "int": ContextType(
        "int", INT_RE, N.is_int, False,
        columns=lambda w: {"key_int": N.int_key(w)},
        parse=parse_int,
        equals=lambda k: F.col("key_int") == k,
        between=lambda a, b: F.col("key_int").between(a, b),
        score=lambda k: S.similar_int(k, F.col("key_int")),
        range_score=lambda a, b: S.similar_range_int(a, b, F.col("key_int")),
    ),
    "date": ContextType(
        "date", DATE_RE, N.is_any_date, False,
        columns=lambda w: {"key_ts": N.date_key(w)},
        parse=parse_date,
        equals=lambda k: F.col("key_ts") == _timestamp(k),
        between=lambda a, b: F.col("key_ts").between(_timestamp(a), _timestamp(b)),
    ),
    "position": _position("position", True),
    "position-rtree": _position("position-rtree", False),
}


def register_type(kind: ContextType) -> None:
    TYPES[kind.name] = kind


@dataclass(frozen=True)
class ContextSchema:
    """A context's declaration."""

    type: str = "text"
    regexp: str | None = None
    normalizers: tuple[str, ...] = ()
    weight: float = 1.0
    default: bool = True

    @property
    def kind(self) -> ContextType:
        return TYPES[self.type]

    @property
    def pattern(self) -> str:
        return self.regexp or self.kind.regexp

    def normal_word(self, word: str) -> str | None:
        """A query word through this context's normalizers; None if one can't take it."""
        for name in self.normalizers:
            if name == "UpperCase":
                word = word.upper()
            elif name == "LowerCase":
                word = word.lower()
            elif name != "ZeroFill":  # numbers compare by value, filled or not
                word = N.normalised_word(name, word)
        return word

    @classmethod
    def from_json(cls, o: dict) -> ContextSchema:
        known = {"type": o["type"], "regexp": o.get("regexp"), "normalizers": tuple(o.get("normalizers") or ()), "weight": float(o.get("weight", 1.0)), "default": bool(o.get("default", True))}
        return cls(**known)

    def to_json(self) -> dict:
        return {"type": self.type, "regexp": self.pattern, "normalizers": list(self.normalizers), "weight": self.weight, "default": self.default}

    def with_(self, **changes) -> ContextSchema:
        return replace(self, **changes)


def schemas_from_rows(rows) -> dict[str, ContextSchema]:
    """cx_name, cx_type, cx_regexp, normalizers, cx_weight, is_default -> schemas by name."""
    return {
        r["cx_name"]: ContextSchema(r["cx_type"], r["cx_regexp"], tuple(r["normalizers"] or ()), 1.0 if r["cx_weight"] is None else float(r["cx_weight"]), r["is_default"] is not False)
        for r in rows
    }
