"""Fuzzy forms of a query word: replacements in both directions and swapped neighbours, cheap ones only."""

from __future__ import annotations

from dataclasses import dataclass

#: Replacement pairs and their costs (fixed values).
ENGLISH = (
    ("l", "ll", 0.2), ("t", "tt", 0.2), ("r", "rr", 0.2), ("e", "ee", 0.2), ("o", "oo", 0.2), ("s", "ss", 0.2),
    ("g", "ck", 0.4), ("k", "ck", 0.4), ("ea", "ee", 0.4), ("ou", "oo", 0.4), ("ou", "au", 0.4), ("ou", "ow", 0.4),
    ("s", "c", 0.6), ("uy", "ye", 0.6), ("y", "ey", 0.6), ("kn", "n", 0.6),
)
GERMAN = (
    ("l", "ll", 0.2), ("t", "tt", 0.2), ("n", "nn", 0.2), ("r", "rr", 0.2), ("i", "ie", 0.2), ("ei", "ie", 0.2), ("k", "ck", 0.2),
    ("d", "t", 0.4), ("b", "p", 0.4), ("g", "k", 0.4), ("g", "ch", 0.4), ("c", "k", 0.4), ("s", "z", 0.4), ("u", "ou", 0.4),
    ("ü", "ue", 0.1), ("ä", "ae", 0.1), ("ö", "oe", 0.1), ("ß", "ss", 0.1),
)


@dataclass(frozen=True)
class FuzzyConfig:
    replace: bool = True
    swap: bool = True
    most: float = 1.0
    pairs: tuple[tuple[str, str, float], ...] = ENGLISH


def fuzz(word: str, config: FuzzyConfig = FuzzyConfig()) -> dict[str, float]:
    """Other spellings with their cost: the pair's share of the dearest pair (1 for a swap), less the later in the word,
    on top of twice the cost of the spelling it comes from; spellings dearer than ``most`` are dropped."""
    dearest = max((c for *_, c in config.pairs), default=1.0)

    def steps(text: str):
        n = len(text)
        for at in range(n):
            weight, rest = (n - at) / n, text[at:]
            if config.replace:
                for a, b, cost in config.pairs:
                    for old, new in ((a, b), (b, a)):
                        if rest.startswith(old):
                            yield text[:at] + new + rest[len(old) :], cost / dearest * weight
            if config.swap and len(rest) > 1:
                yield text[:at] + rest[1] + rest[0] + rest[2:], weight

    best: dict[str, float] = {}
    level = {word: 0.0}
    while level:
        following: dict[str, float] = {}
        for text, base in level.items():
            for other, cost in steps(text):
                total = base + cost
                if total <= config.most and total < min(best.get(other, 2 * config.most + 1), following.get(other, 2 * config.most + 1)):
                    following[other] = total
        best |= following
        level = {t: 2 * c for t, c in following.items() if 2 * c <= config.most}
    best.pop(word, None)
    return best


def by_cost(forms: dict[str, float]) -> list[tuple[str, float]]:
    return sorted(forms.items(), key=lambda f: (f[1], f[0]))
