"""The speech of a text that may be a subtitle file: cues in time order, without markup, sounds, labels and adverts."""

from __future__ import annotations

import re
import unicodedata

_TIMING = re.compile(r"^[ \t]*(?:\d+[ \t]*\n[ \t]*)?((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})[ \t]*-->[^\n]*(?:\n|\Z)", re.M)
#: Stands between two cues; what is opened in one is closed in it or in the next, however long.
_CUT = "\x1e"
_WITHIN = r"[^{0}\x1e]*(?:\x1e[^{0}\x1e]*)?"
_MARKUP = re.compile(rf"<{_WITHIN.format('<>')}>|\{{{_WITHIN.format('{}')}\}}")
_SOUND = re.compile(rf"\[{_WITHIN.format('[' + chr(92) + ']')}\]|\({_WITHIN.format('()')}\)|♪{_WITHIN.format('♪')}♪|\*[^*\n\x1e]*\*")
_LABEL = re.compile(r"^([^\w\n]*)[A-Z][A-Z0-9]*(?: [A-Z0-9]+)?:(?=\s)", re.M)
_ADVERT = re.compile(
    r"https?://|www\.|\S@\S|\b[a-z0-9-]+\.[a-z0-9-]+\.[a-z]{2,}|subtitles by|corrected by|ripped by|^\W*transcript:", re.I | re.M
)
#: What wrong encodings leave of accented letters and typographic quotes, and the accented letters themselves.
_LOST = {c: None for c in [*range(0x80, 0xA0), *range(0xA1, 0x250), 0x2C6, 0x2DC, *range(0x2018, 0x2020), 0x2020, 0x2021, 0x2022, 0x2026, 0x2030, 0x2039, 0x203A, 0x20AC, 0x2122, 0xFFFD, 0xFEFF, 0x200B, 0xAD]}
_LOST |= {0xA0: " ", **{c: " " for c in range(0x2010, 0x2016)}, ord("'"): None}
#: Letters and digits that recognition takes for each other, one sign for each class.
_READ_AS = str.maketrans("ecli1|o0tfhb5", "cciiiiooffbbs")
_DIGITS = str.maketrans("oilsbz", "011582")
_WORD = re.compile(r"[^\W_]+")


def _seconds(stamp: str) -> float:
    total = 0.0
    for part in stamp.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def cues(text: str) -> list[str]:
    """Cue texts in order of their start times (equal times: in file order). A text without timings is one cue."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    parts = _TIMING.split(text)
    if len(parts) == 1:
        return [text]
    timed = [(_seconds(parts[i]), parts[i + 1]) for i in range(1, len(parts), 2)]
    if any(a[0] > b[0] for a, b in zip(timed, timed[1:])):
        timed.sort(key=lambda c: c[0])
    return [c for _, c in timed]


def speech(text: str | None) -> str:
    """What is spoken, cues joined by line ends; empty for null."""
    if not text:
        return ""
    kept = [c for c in cues(text) if not _ADVERT.search(c)]
    joined = f"\n{_CUT}".join(c.replace(_CUT, " ") for c in kept)
    if "<" in joined or "{" in joined:
        joined = _MARKUP.sub(" ", joined)
    joined = _SOUND.sub(" ", joined)
    joined = joined.replace(_CUT, "")
    return _LABEL.sub(r"\1", joined) if ":" in joined else joined


def tokens(spoken: str) -> list[str]:
    """Words as written but for what encodings lose: accents, quotes, apostrophes."""
    if not spoken.isascii():
        spoken = unicodedata.normalize("NFC", spoken).replace("Â\xa0", " ").replace("Ã\xa0", "").translate(_LOST)
    elif "'" in spoken:
        spoken = spoken.replace("'", "")
    return _WORD.findall(spoken)


def skeleton(token: str) -> str:
    """One form for all readings of a word; numbers keep their digits, and misread digits are put right."""
    t = token.lower()
    if any(c.isdigit() for c in t):
        number = t.translate(_DIGITS)
        if number.isdigit():
            return number
    return t.replace("rn", "m").replace("vv", "w").translate(_READ_AS)
