"""Main content of web pages: path ratios over the lines of fetched pages.

A page that comes as lines, without tags, has instead of a line's root-to-leaf path what stands for its tags: its zone
(before or after the heading), the kind of frame line it follows, its distance from it, and its shape. Over the whole
corpus, text length and punctuation are aggregated per line template and per path; ratios are smoothed over neighbouring
lines and along the distance, fused, and thresholded: every path is content, frame, or undecided, and only inside
undecided paths a line's own shape and place decide. ``html_content`` does the same for pages with tags.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.lookalikes import by_table
from termloom.runtime import checkpointed

#: Words on at least this share of the pages stand for themselves in a template (so there are at most mean distinct
#: words per page / WORD_SHARE of them), sites with at least SITE_SHARE of the pages are masked by name.
WORD_SHARE = 0.005
SITE_SHARE = 0.001
#: A template on at least this share of differently titled pages, and on FRAME_LEAST of them, belongs to the frame.
FRAME_SHARE = 0.01
FRAME_LEAST = 4
#: Furthest distance from a frame line that has paths of its own; what lies further shares the last one's.
REACH = 6
#: Smoothed ratio of a path, over that of lines that follow no frame line, from which it is content, and below which it
#: is frame.
CONTENT, FRAME = 0.25, 0.025

_LETTERS = re.compile(r"[^\W\d_]+")
_MENU = re.compile(r"[^.!?|·/]{1,40}?(?: ?[|·] ?| / |  +)[^.!?]*")
_SENTENCE = re.compile(r"[.!?][\"”’)\]]*(?=\s|$)")
_HOST = re.compile(r"\s*https?://(?:[^/@?#]*@)?([^/:?#\s]+)", re.I)
LINES = "record_id {}, line_no int, line string"


def site(uri: str | None) -> str:
    """The label under the top-level one of an http(s) URI's host."""
    m = _HOST.match(uri or "")
    labels = m[1].lower().rstrip(".").split(".") if m else []
    return labels[-2] if len(labels) > 1 else "".join(labels)


def template(line: str, known: frozenset) -> str | None:
    """The line with rare words, numbers and site names masked; null if nothing known is left."""
    words = line.split()
    masked = [w if w in known else "<>" for w in words]
    return " ".join(masked) if masked.count("<>") < len(words) else None


def shape(line: str) -> str:
    """empty, menu, trail, quote, item ('- '), star ('* '), text (several sentences), sentence or short."""
    line = line.strip()
    if not line:
        return "empty"
    ends = len(_SENTENCE.findall(line))
    if line.startswith("> "):
        return "quote"
    if " > " in line and not ends:
        return "trail"
    if not ends and len(line) < 160 and _MENU.fullmatch(line):
        return "menu"
    if line.startswith(("- ", "– ", "• ")):
        return "item"
    if line.startswith("* "):
        return "star"
    words = len(line.split())
    if ends > 1 or words > 22:
        return "text"
    return "sentence" if ends or words > 7 else "short"


def _find_title(lines: list[str], title: str | None) -> int | None:
    """The first line that shows the title; case and look-alike characters don't matter."""
    title = title.strip() if title else ""
    if not title:
        return None
    shown = None
    for i, line in enumerate(lines):
        if line.strip() == title:
            return i
        if not line.isascii() or not title.isascii() or len(line.strip()) == len(title):
            shown = shown or by_table(title).casefold()
            if by_table(line).strip().casefold() == shown:
                return i
    return None


def _page_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uri, text, title) -> pages per word and per site; the null word counts all pages."""
    words: Counter = Counter()
    sites: Counter = Counter()
    n = 0
    for b in batches:
        for uri, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            n += 1
            words.update(set((text or "").split()))
            sites[site(uri)] += 1
    yield pa.RecordBatch.from_arrays(
        [pa.array([None, *words, *sites], pa.string()), pa.array([False] + [False] * len(words) + [True] * len(sites)), pa.array([n, *words.values(), *sites.values()], pa.int64())],
        ["word", "is_site", "pages"],
    )


def _page_templates(batches: Iterator[pa.RecordBatch], known: frozenset) -> Iterator[pa.RecordBatch]:
    """One row per template and page, with what identifies copies of the page: its title, else its first long line."""
    for b in batches:
        out_t, out_p = [], []
        for text, title in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            lines = (text or "").split("\n")
            same = title or max(lines, key=len)
            found = {t for t in (template(line, known) for line in lines) if t}
            out_t += found
            out_p += [same] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(out_t, pa.string()), pa.array(out_p, pa.string())], ["template", "page"])


def _walk(lines: list[str], title: str | None, known: frozenset, frame: frozenset):
    """(line_no, path, line) of the lines that are no frame by themselves. path: zone, frame line followed, distance, shape."""
    heading = _find_title(lines, title)
    head, distance = "", 0
    for i, line in enumerate(lines):
        if i == heading:
            yield i, ("heading", "", 0, shape(line)), line
            head, distance = "", 0
            continue
        t = template(line, known)
        if t in frame:
            head, distance = t, 0
            continue
        kind = shape(line)
        if kind in ("empty", "menu", "trail"):
            continue
        distance = min(distance + 1, REACH)
        zone = "before" if heading is not None and i < heading else "body"
        yield i, (zone, head, distance if head else 0, kind), line
        if kind in ("text", "quote", "item"):
            head = ""


def _fused(line: str) -> float:
    """Text length and punctuation of a line in one number."""
    return len(line.strip()) * (1.0 + len(re.findall(r"[.,;:!?]", line)))


def _smoothed(walked: list) -> list[float]:
    """Fused ratio of every line with half of its neighbours'; neighbours lie in the same zone and under the same frame
    line."""
    own = [_fused(line) for _, _, line in walked]
    out = []
    for j, (_, path, _) in enumerate(walked):
        total, weight = 2 * own[j], 2
        if j and walked[j - 1][1][0] == path[0] and not (path[1] and path[2] == 1):
            total, weight = total + own[j - 1], weight + 1
        if j + 1 < len(walked) and walked[j + 1][1][0] == path[0] and not (walked[j + 1][1][1] and walked[j + 1][1][2] == 1):
            total, weight = total + own[j + 1], weight + 1
        out.append(total / weight)
    return out


def _path_lines(batches: Iterator[pa.RecordBatch], known: frozenset, frame: frozenset) -> Iterator[pa.RecordBatch]:
    """Lines, text length, punctuation and smoothed ratio per path."""
    total: dict[tuple, list[float]] = {}
    for b in batches:
        for text, title in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            walked = list(_walk((text or "").split("\n"), title, known, frame))
            for (_, path, line), around in zip(walked, _smoothed(walked)):
                s = total.setdefault(path, [0, 0, 0, 0.0])
                s[0] += 1
                s[1] += len(line.strip())
                s[2] += len(re.findall(r"[.,;:!?]", line))
                s[3] += around
    paths = list(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in paths], pa.string()), pa.array([p[1] for p in paths], pa.string()), pa.array([p[2] for p in paths], pa.int32()), pa.array([p[3] for p in paths], pa.string())]
        + [pa.array([total[p][k] for p in paths], pa.int64()) for k in range(3)]
        + [pa.array([total[p][3] for p in paths], pa.float64())],
        ["zone", "head", "distance", "shape", "lines", "chars", "marks", "around"],
    )


def _content(batches: Iterator[pa.RecordBatch], known: frozenset, frame: frozenset, heads: dict[str, int], verdicts: dict[tuple, int], with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, numbers, texts = [], [], []
        for i, text, title in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            lines = (text or "").split("\n")
            for n in content_lines(lines, title, known, frame, heads, verdicts):
                ids.append(i)
                numbers.append(n)
                texts.append(lines[n] if with_text else None)
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], ["record_id", "line_no", "line"])


def _kind_of_path(path: tuple, heads: dict[str, int]) -> tuple:
    """A line's path with the kind of the frame line it follows in place of that line."""
    zone, head, distance, kind = path
    return zone, "teasers" if head in heads else "notice" if head else "", distance, kind


def content_lines(lines: list[str], title: str | None, known: frozenset, frame: frozenset, heads: dict[str, int], verdicts: dict[tuple, int]) -> list[int]:
    """Numbers of the main body's lines. ``heads``: frame lines that open a list of teasers, with its reach; ``verdicts``:
    1 for content paths, -1 for frame paths. Nothing before the heading is of the body."""
    walked = list(_walk(lines, title, known, frame))
    kept: list[int] = []
    for at, (i, path, _) in enumerate(walked):
        zone, head, distance, kind = path
        if zone == "heading":
            kept.append(i)
            continue
        verdict = verdicts.get(_kind_of_path(path, heads), 0)
        if zone == "before" or verdict < 0:
            continue
        if verdict > 0 or kind in ("text", "quote", "item"):
            kept.append(i)
        elif head in heads and distance <= heads[head]:
            continue
        elif not head or _after_notice(walked, at):
            kept.append(i)
    return kept


def _after_notice(walked: list, at: int) -> bool:
    """Whether a short line or a sentence that follows a notice is of the body. The run of such lines ends with text of
    the body or with another frame line; a run with starred lines, or with short ones that lead to no text, is a list
    of teasers. Before text, sentences and the last short line, its sub-heading, belong to the body."""
    head = walked[at][1][1]
    first = at
    while walked[first][1][2] > 1 and first and walked[first - 1][1][1] == head and walked[first - 1][1][2] < walked[first][1][2]:
        first -= 1
    last = at
    while last + 1 < len(walked) and walked[last + 1][1][1] == head and (walked[last + 1][1][2] > walked[last][1][2] or walked[last + 1][1][2] == REACH):
        last += 1
    kinds = [w[1][3] for w in walked[first : last + 1]]
    ends_in_text = kinds[-1] in ("text", "quote", "item")
    if "star" in kinds or ("short" in kinds and not ends_in_text):
        return False
    return walked[at][1][3] == "sentence" or (ends_in_text and at == last - 1)


class PathRatios:
    """Frame templates and teaser heads learned from a table of pages (record_id, uri, text, title).

    Null texts have no lines. Repeated and almost repeated pages count once for what is frame, by their title. What is
    collected is bounded by the shares above, not by the corpus.
    """

    def __init__(self, pages: DataFrame) -> None:
        stats = pages.mapInArrow(_page_words, "word string, is_site boolean, pages long").groupBy("word", "is_site").agg(F.sum("pages").alias("pages"))
        stats = checkpointed(stats)
        n = (stats.where("word is null").agg(F.sum("pages")).first()[0]) or 0
        words = {r[0] for r in stats.where(~F.col("is_site") & (F.col("pages") >= WORD_SHARE * n)).where("word is not null").select("word").collect()}
        sites = {r[0] for r in stats.where(F.col("is_site") & (F.col("pages") >= SITE_SHARE * n)).select("word").collect()}
        self.known = frozenset(w for w in words if any(map(str.isalpha, w)) and not {x.lower() for x in _LETTERS.findall(w)} & sites)
        per_page = pages.mapInArrow(partial(_page_templates, known=self.known), "template string, page string")
        counted = per_page.select("template", F.xxhash64("page").alias("page")).distinct().groupBy("template").agg(F.count("*").alias("pages"))
        titles = pages.agg(F.approx_count_distinct(F.coalesce("title", "text"), 0.02)).first()[0]
        least = max(FRAME_LEAST, FRAME_SHARE * titles)
        frame = {r["template"]: r["pages"] for r in counted.where(F.col("pages") >= least).collect()}
        self.frame = frozenset(frame)
        paths = pages.mapInArrow(partial(_path_lines, known=self.known, frame=self.frame), "zone string, head string, distance int, shape string, lines long, chars long, marks long, around double")
        self.paths = paths.groupBy("zone", "head", "distance", "shape").agg(*[F.sum(c).alias(c) for c in ("lines", "chars", "marks", "around")]).collect()
        self.heads = self._teaser_heads(frame)
        self.verdicts = self._verdicts()

    def _verdicts(self) -> dict[tuple, int]:
        """Paths by the threshold on their smoothed ratio, pooled over the frame lines of one kind."""
        pooled: dict[tuple, list[float]] = {}
        plain = [0.0, 0.0]
        for r in self.paths:
            cells = [pooled.setdefault(_kind_of_path((r["zone"], r["head"], r["distance"], r["shape"]), self.heads), [0.0, 0.0])]
            if r["zone"] == "body" and not r["head"]:
                cells.append(plain)
            for cell in cells:
                cell[0] += r["lines"]
                cell[1] += r["around"]
        base = plain[1] / plain[0] if plain[0] else 0.0
        ratio = {p: around / n for p, (n, around) in pooled.items()}
        return {p: 1 if x >= CONTENT * base else -1 if x < FRAME * base else 0 for p, x in ratio.items()} if base else {}

    def _teaser_heads(self, frame: dict[str, int]) -> dict[str, int]:
        """Frame lines whose followers carry little text and punctuation, with the distance up to which they do: the
        fused, smoothed ratio of a path stays under half of that of lines that follow no frame line. A line that is
        rarely followed by any (a menu entry) is no head."""
        base_n = base = 0
        at: dict[str, dict[int, list[float]]] = {}
        for r in self.paths:
            fused = (r["chars"] / r["lines"]) * (1 + r["marks"] / r["lines"]) * r["lines"]
            if r["zone"] == "body" and not r["head"]:
                base, base_n = base + fused, base_n + r["lines"]
            elif r["zone"] == "body":
                cell = at.setdefault(r["head"], {}).setdefault(r["distance"], [0.0, 0.0])
                cell[0] += fused
                cell[1] += r["lines"]
        limit = 0.5 * base / base_n if base_n else 0.0
        heads = {}
        for head, cells in at.items():
            if 1 not in cells or cells[1][1] < 0.3 * frame[head] or cells[1][0] / cells[1][1] >= 0.3 * limit:
                continue
            reach = 1
            while reach < REACH:
                near = [cells[k] for k in range(reach, reach + 3) if k in cells]
                if not near or sum(c[0] for c in near) / sum(c[1] for c in near) >= limit:
                    break
                reach += 1
            heads[head] = reach
        return heads

    def extract(self, pages: DataFrame, with_text: bool = True) -> DataFrame:
        """record_id, line_no (from 0), line (null without text): the lines of the main body."""
        kind = pages.schema["record_id"].dataType.simpleString()
        return pages.mapInArrow(partial(_content, known=self.known, frame=self.frame, heads=self.heads, verdicts=self.verdicts, with_text=with_text), LINES.format(kind))


def pages_of(df: DataFrame, record_id: str, uri: str, text: str | None, title: str | None) -> DataFrame:
    """The columns the operator reads, of the rows whose URI starts with http (blanks around it aside)."""
    rows = df.where(F.lower(F.regexp_replace(uri, r"^\s+", "")).startswith("http"))
    return rows.select(F.col(record_id).alias("record_id"), F.col(uri).alias("uri"), F.expr(text).alias("text"), F.expr(title).alias("title"))


class _Blocks(HTMLParser):
    """Text blocks of a page with their root-to-leaf tag paths; tags that don't break lines are no part of a path."""

    INLINE = frozenset("a abbr b bdi bdo cite code em font i img kbd mark q s small span strong sub sup time tt u var wbr br".split())
    UNSEEN = frozenset("script style noscript template head".split())
    VOID = frozenset("area base col embed hr img input link meta param source track wbr br".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.blocks: list[tuple[str, str]] = []
        self.text: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text and not self.UNSEEN.intersection(self.open):
            self.blocks.append(("/".join(self.open), text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        if tag not in self.INLINE:
            self.flush()
            if tag not in self.VOID:
                self.open.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.flush()
            if tag in self.open:
                del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data):
        self.text.append(data)


def blocks_of(html: str | None) -> list[tuple[str, str]]:
    """(tag path, text) of the blocks of a page, in order; none for a null page."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def _html_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, uri, html in zip(*(b.column(k).to_pylist() for k in range(3))):
            rows += [(i, n, site(uri), path, text, float(len(text)), float(len(re.findall(r"[.,;:!?]", text)))) for n, (path, text) in enumerate(blocks_of(html))]
        kinds = [b.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = list(zip(*rows)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["record_id", "block_no", "site", "path", "text", "chars", "marks"])


def html_content(pages: DataFrame, record_id: str, uri: str, html: str, threshold: float = 0.5) -> DataFrame:
    """record_id, block_no, text: the blocks of each page's main body, by tag-path ratios.

    Per site and root-to-leaf tag path, text length and punctuation marks per block are averaged and fused into one ratio;
    along each page the ratios of neighbouring blocks are smoothed; blocks whose smoothed ratio, or whose path's own,
    reaches ``threshold`` of the mean ratio of the site's text, by characters, are content. Statistics are per site, so
    no site's frame is measured by another's; a path of a hot site is one row for the join. Null pages have no blocks;
    repeated rows of one record are one page each only if their ids differ.
    """
    kind = pages.schema[record_id].dataType.simpleString()
    rows = pages.select(F.col(record_id).alias("record_id"), F.col(uri).alias("uri"), F.col(html).alias("html"))
    blocks = checkpointed(rows.mapInArrow(_html_blocks, f"record_id {kind}, block_no int, site string, path string, text string, chars double, marks double"))
    paths = blocks.groupBy("site", "path").agg(F.avg("chars").alias("length"), F.avg("marks").alias("dots"), F.sum("chars").alias("chars"))
    ratios = paths.withColumn("ratio", F.col("length") * (1 + F.col("dots")))
    limits = ratios.groupBy("site").agg((F.sum(F.col("ratio") * F.col("chars")) / F.sum("chars") * threshold).alias("limit"))
    rated = blocks.join(ratios.select("site", "path", "ratio"), ["site", "path"]).join(limits, "site")
    near = Window.partitionBy("record_id").orderBy("block_no").rowsBetween(-1, 1)
    smoothed = rated.withColumn("smooth", F.avg("ratio").over(near))
    return smoothed.where((F.col("smooth") >= F.col("limit")) & (F.col("ratio") * 8 >= F.col("limit")) | (F.col("ratio") >= F.col("limit"))).select("record_id", "block_no", "text")
