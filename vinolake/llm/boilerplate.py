"""Main content of web pages: parser events, text-to-tag ratios, smoothing and threshold clustering, corrected by the shop's frame.

Each line of a page gets a text-to-tag ratio from the events of the standard
library's streaming parser. The ratio alone cannot tell a menu from a list of
growers, and pages of plain text have no tags at all; so lines that the frame
of the shop repeats are known from counts over all its pages and weigh nothing,
as do breadcrumbs, side lists and suggestions. What is left is smoothed with a
Gaussian along the page and cut by two-means clustering; content runs are the
maximal runs of non-furniture lines that reach above the cut.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from html.parser import HTMLParser

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinolake.operators.scale import fits, map_columns, small_side, spread, written

OTHER, ITEM, DATED, PRICE = 0, 1, 2, 3
#: A line in this share of a shop's pages is frame.
FRAME_SHARE = 0.3
#: A rarer line is frame if it mostly stands directly before frame lines.
EDGE_SHARE, EDGE_RATE = 0.15, 0.4
#: Fewest pages a line must be on to count as repeated at all.
FRAME_PAGES = 3
#: A line of so few words may be a fact: it is frame only if it stands beside frame, or at
#: the top or foot of the page, in this share of its places.
FACT_WORDS, PLACE_RATE = 3, 0.6
#: Where between the two cluster centres the cut lies.
CUT = 0.15

_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_LETTERS = re.compile(r"[^\W\d_][\W\d_]*[^\W\d_]")
_MONEY = r"(?:[€$£]\s?\d{1,4}(?:[.,]\d{2})?|\d{1,4}(?:[.,]\d{2})?\s?(?:€|eur\b|\$|£))"
_PRICE = re.compile(rf"^{_MONEY}$", re.I)
_ITEM = re.compile(rf"^\D{{3,80}}?.{{0,12}}\s{_MONEY}$", re.I)
_DATED = re.compile(r"^\D{3,80}\s(?:19|20)\d\d$")
_CRUMB = re.compile(r"\s+[>»›/|→]\s+")
_SHARE = re.compile(r"\b(?:share|partager?|partagez|teilen|delen|deel)\b", re.I)
_SILENT = {"script", "style", "noscript", "template", "title", "svg"}


class _Lines(HTMLParser):
    """Text, tags and link text of each line, from parser events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text: dict[int, list[str]] = {}
        self.tags: dict[int, int] = {}
        self.linked: dict[int, int] = {}
        self.silent, self.link = 0, 0

    def _line(self) -> int:
        return self.getpos()[0] - 1

    def handle_starttag(self, tag, attrs):
        self.tags[self._line()] = self.tags.get(self._line(), 0) + 1
        self.silent += tag in _SILENT
        self.link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.tags[self._line()] = self.tags.get(self._line(), 0) + 1

    def handle_endtag(self, tag):
        self.tags[self._line()] = self.tags.get(self._line(), 0) + 1
        if tag in _SILENT and self.silent:
            self.silent -= 1
        if tag == "a" and self.link:
            self.link -= 1

    def handle_data(self, data):
        if self.silent:
            return
        for k, part in enumerate(data.split("\n")):
            if part.strip():
                at = self._line() + k
                self.text.setdefault(at, []).append(part)
                if self.link:
                    self.linked[at] = self.linked.get(at, 0) + len(part.strip())


class _Events(HTMLParser):
    """The events of one line: strings, and how many silent elements and links open (1) or close (-1) between them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, object]] = []
        self.tags = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in _SILENT or tag == "a":
            self.events.append(("link" if tag == "a" else "silent", 1))

    def handle_startendtag(self, tag, attrs):
        self.tags += 1

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in _SILENT or tag == "a":
            self.events.append(("link" if tag == "a" else "silent", -1))

    def handle_data(self, data):
        if data.strip():
            self.events.append(("text", data))


@lru_cache(maxsize=100_000)
def _line_events(line: str) -> tuple[int, tuple]:
    """(tags, events) of a line; the lines of a shop's frame are the same on all its pages, so most are parsed once."""
    if "<" not in line and "&" not in line:
        return 0, (("text", line),) if line.strip() else ()
    parser = _Events()
    parser.feed(line)
    parser.close()
    return parser.tags, tuple(parser.events)


#: What makes events depend on other lines: comments, declarations, and elements whose content is no markup.
_SPANNING = re.compile(r"<!--|<!\[|<\?|<(script|style|textarea|title|noscript|iframe|xmp|plaintext)\b(?![^\n]*</\1\s*>)", re.I)


def _stands_alone(lines: list[str], body: str) -> bool:
    """Whether every tag of the page ends on the line it begins on, so that lines can be parsed one by one."""
    return not _SPANNING.search(body) and all("<" not in x or x.rfind("<") < x.rfind(">") and x.count('"') % 2 == 0 for x in lines)


def page_lines(body: str) -> list[tuple[int, str, int, int]]:
    """(line number, text, tags, characters inside links) of the lines that carry text; lines split at line feeds."""
    body = body.replace("\r", " ")
    lines = body.split("\n")
    if "<" not in body:
        return [(k, t, 0, 0) for k, x in enumerate(lines) if (t := _SPACE.sub(" ", x).strip())]
    out = []
    if _stands_alone(lines, body):
        silent = link = 0
        for k, line in enumerate(lines):
            tags, events = _line_events(line)
            said, linked = [], 0
            for kind, what in events:
                if kind == "silent":
                    silent = max(0, silent + what)
                elif kind == "link":
                    link = max(0, link + what)
                elif not silent:
                    said.append(what)
                    linked += len(what.strip()) if link else 0
            text = _SPACE.sub(" ", " ".join(said)).strip() if said else ""
            if text:
                out.append((k, text, tags, min(linked, len(text))))
        return out
    parser = _Lines()
    parser.feed(body)
    parser.close()
    for k in sorted(parser.text):
        text = _SPACE.sub(" ", " ".join(parser.text[k])).strip()
        if text:
            out.append((k, text, parser.tags.get(k, 0), min(parser.linked.get(k, 0), len(text))))
    return out


def line_kind(text: str) -> int:
    if _PRICE.match(text):
        return PRICE
    if _ITEM.match(text) and len(text.split()) <= 14:
        return ITEM
    return DATED if _DATED.match(text) and len(text.split()) <= 10 else OTHER


def line_hash(text: str) -> int:
    """Hash of a line with its numbers masked; 0 for a line of numbers and signs only."""
    masked = _DIGITS.sub("#", text.lower())
    if not _LETTERS.search(masked):
        return 0
    return xxhash.xxh64_intdigest(masked) - (1 << 63)


@lru_cache(maxsize=100_000)
def _features(text: str) -> tuple[int, int, int, int, int, int]:
    """(length, kind, words, hash, hash of a breadcrumb's first segment or 0, whether it is short enough for a fact) of a line."""
    words = len(text.split())
    return len(text), line_kind(text), words, line_hash(text), line_hash(_CRUMB.split(text)[0]) if _CRUMB.search(text) else 0, int(words <= FACT_WORDS and not _SHARE.search(text))


def _parsed(pages: DataFrame) -> DataFrame:
    """Per page the parallel arrays of its text lines, and crumb: the hash of a breadcrumb's first segment or 0."""

    def parse(page_id, shop, bodies):
        rows = []
        for body in bodies:
            ls = page_lines(body)
            kinds = [_features(x[1]) for x in ls]
            rows.append(([x[0] for x in ls], [f[0] for f in kinds], [x[2] for x in ls], [x[3] for x in ls], *([f[c] for f in kinds] for c in range(1, 6))))
        return page_id, shop, *zip(*rows)

    return map_columns(spread(pages), "page_id bigint, shop string, n array<int>, len array<int>, tags array<int>, linked array<int>, kind array<int>, words array<int>, hash array<bigint>, crumb array<bigint>, fact array<int>", parse)


def loose_facts(lines, links, sure) -> list[int]:
    """Hashes of the short lines that shares alone would make frame, but that have no stable place.

    ``lines`` are (hash, edge rate, list rate, fact, places), ``links`` (hash, side,
    neighbour or None at the end of a page, places). From the top, the foot and the
    other frame lines on, a short line is fixed if what is fixed stands on one side
    of it in PLACE_RATE of its places: facts between content lines never are.
    """
    sure = set(sure)
    framed = {h: n for h, edge, heads, _, n in lines if h in sure or edge >= EDGE_RATE or heads >= 0.9}
    fixed = {h for h, _, heads, fact, _ in lines if h in framed and (not fact or heads >= 0.9)}
    while True:
        held: dict[tuple[int, int], int] = {}
        for h, side, beside, n in links:
            if h in framed and h not in fixed and (beside is None or beside in fixed):
                held[h, side] = held.get((h, side), 0) + n
        new = {h for (h, _), n in held.items() if n >= PLACE_RATE * framed[h]}
        if not new:
            return sorted(framed.keys() - fixed)
        fixed |= new


def shop_frames(parsed: DataFrame) -> DataFrame:
    """Per shop the hashes of its frame lines, of the frame lines that head a list, and of all lines on several pages.

    Counted over all pages of a shop, aggregated before the shuffle. A shop has
    at most (lines of a page / share) frame lines, so a row stays small.
    """
    pages = parsed.groupBy(F.col("shop").alias("_s")).agg(F.count("*").alias("pages"))
    counts = parsed.select("shop", F.explode(F.array_distinct("hash")).alias("hash")).where("hash <> 0").groupBy("shop", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= FRAME_PAGES)
    shares = counts.join(small_side(pages), F.col("shop").eqNullSafe(F.col("_s"))).select("shop", "hash", (F.col("n") / F.col("pages")).alias("share"))
    repeated = shares.where(F.col("share") >= 0.02).groupBy("shop").agg(
        F.collect_list(F.when(F.col("share") >= FRAME_SHARE, F.col("hash"))).alias("sure"),
        F.collect_list(F.when((F.col("share") >= EDGE_SHARE) & (F.col("share") < FRAME_SHARE), F.col("hash"))).alias("maybe"),
        F.collect_list("hash").alias("repeated"),
    )
    repeated = written(repeated, "frames")
    both = parsed.join(small_side(repeated.select(F.col("shop").alias("_s"), "sure", "maybe")), F.col("shop").eqNullSafe(F.col("_s")))
    # What follows each line that is or may be frame: the next text line of the page.
    follow = F.transform(F.col("hash"), lambda h, i: F.struct(h.alias("h"), F.get(F.col("hash"), i - 1).alias("prev"), F.get(F.col("hash"), i + 1).alias("next"), F.get(F.col("kind"), i + 1).alias("kind"), F.get(F.col("fact"), i).alias("fact")))
    wanted = F.filter(follow, lambda x: F.array_contains(F.col("sure"), x["h"]) | F.array_contains(F.col("maybe"), x["h"]))
    seen = both.select("shop", "sure", "maybe", F.explode(wanted).alias("x")).select(
        "shop", "sure", "maybe", F.col("x.h").alias("h"), F.col("x.prev").alias("prev"), F.col("x.next").alias("next"), F.col("x.fact").alias("fact"),
        (F.col("x.next").isNull() | F.coalesce(F.array_contains("sure", F.col("x.next")), F.lit(False))).cast("int").alias("edge"),
        F.coalesce(F.col("x.kind").isin(DATED, ITEM), F.lit(False)).cast("int").alias("list"),
    )
    beside = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("prev").alias("nb")), F.struct(F.lit(1).alias("side"), F.col("next").alias("nb"))))
    known = F.col("x.nb").isNull() | F.array_contains("sure", F.col("x.nb")) | F.array_contains("maybe", F.col("x.nb"))
    links = seen.where("fact = 1").select("shop", "h", "sure", "maybe", beside.alias("x")).where(known).groupBy("shop", "h", F.col("x.side").alias("side"), F.col("x.nb").alias("nb")).agg(F.count("*").alias("n"))
    links = links.groupBy(F.col("shop").alias("_l")).agg(F.collect_list(F.struct("h", "side", "nb", "n")).alias("links"))
    rates = seen.groupBy("shop", "h").agg(F.avg("edge").alias("edge"), F.avg("list").alias("list"), F.max("fact").alias("fact"), F.count("*").alias("n"))
    tail = rates.groupBy("shop").agg(F.collect_list(F.when(F.col("edge") >= EDGE_RATE, F.col("h"))).alias("edges"), F.collect_list(F.when(F.col("list") >= 0.9, F.col("h"))).alias("heads"), F.collect_list(F.struct("h", "edge", "list", "fact", "n")).alias("lines"))
    tail = tail.join(small_side(links), F.col("shop").eqNullSafe(F.col("_l")), "left").drop("_l")

    @F.udf("array<bigint>")
    def loose(lines, links, sure):
        return loose_facts(lines or [], links or [], sure or [])

    r, t = repeated.alias("r"), tail.alias("t")
    none = F.array().cast("array<bigint>")
    out = r.join(t, F.col("r.shop").eqNullSafe(F.col("t.shop")), "left").select("r.shop", "sure", "maybe", "repeated", F.coalesce("edges", none).alias("edges"), F.coalesce("heads", none).alias("heads"), loose("lines", "links", "sure").alias("_x"))
    return out.withColumn("sure", F.array_except("sure", "_x")).withColumn("edges", F.array_except("edges", "_x")).drop("_x")


def furniture(kinds, words, hashes, crumbs, sure: set, edges: set, heads: set, repeated: set) -> list[bool]:
    """Which lines of a page are frame, breadcrumb, side list or suggestion."""
    n = len(kinds)
    out = [False] * n
    suggesting = False
    for k in range(n):
        h = hashes[k]
        framed = h in sure or h in edges or h in heads
        if framed or (crumbs[k] and crumbs[k] in sure):
            out[k], suggesting = True, h in heads
        elif kinds[k] == ITEM and (k and out[k - 1] and kinds[k - 1] == ITEM or k and words[k - 1] <= 5 and hashes[k - 1] in repeated and kinds[k - 1] == OTHER):
            # a run of "name year price" lines under a short repeated heading
            out[k], suggesting = True, False
            if kinds[k - 1] != ITEM:
                out[k - 1] = True
        elif suggesting and kinds[k] in (DATED, PRICE, ITEM):
            out[k] = True
        else:
            suggesting = False
    return out


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing along the lines; the ends keep their weight."""
    radius = int(3 * sigma)
    kernel = [math.exp(-((d / sigma) ** 2) / 2) for d in range(-radius, radius + 1)]
    n = len(values)
    out = []
    for k in range(n):
        num = den = 0.0
        for d in range(max(-radius, -k), min(radius, n - 1 - k) + 1):
            w = kernel[d + radius]
            num += w * values[k + d]
            den += w
        out.append(num / den)
    return out


def two_means(values: list[float], rounds: int = 20) -> tuple[float, float]:
    """Centres of the two clusters of one-dimensional values."""
    lo, hi = min(values), max(values)
    for _ in range(rounds):
        mid = (lo + hi) / 2
        a, b = [v for v in values if v <= mid], [v for v in values if v > mid]
        if not a or not b:
            break
        new = (sum(a) / len(a), sum(b) / len(b))
        if new == (lo, hi):
            break
        lo, hi = new
    return lo, hi


def content_flags(lengths, tags, linked, bare: list[bool]) -> list[bool]:
    """Lines of the content regions: runs of non-furniture lines whose smoothed ratio reaches the cut."""
    if not lengths:
        return []
    ratios = [0.0 if f else math.log1p((n - 0.9 * a) / (t + 1)) for n, t, a, f in zip(lengths, tags, linked, bare)]
    smooth = smoothed(ratios)
    lo, hi = two_means(smooth)
    cut = lo + CUT * (hi - lo)
    out, k = [False] * len(ratios), 0
    while k < len(ratios):
        if bare[k]:
            k += 1
            continue
        end = k
        while end < len(ratios) and not bare[end]:
            end += 1
        if max(smooth[k:end]) >= cut:
            out[k:end] = [True] * (end - k)
        k = end
    return out


def main_content(pages: DataFrame) -> DataFrame:
    """(page_id, line_no) of the content lines of every page (columns page_id, shop, body).

    Null and empty bodies give no lines; a repeated page gives repeated rows; a
    shop seen on fewer than FRAME_PAGES pages has no frame, so only ratios and
    list shapes decide there. Whole bodies are read. One parse per page; the
    parsed arrays are written to the shared folder and read three times.
    """
    parsed = written(_parsed(pages.select(F.col("page_id").cast("long"), "shop", "body").where("page_id is not null and body is not null")), "lines")
    sides = written(shop_frames(parsed).select(F.col("shop").alias("_s"), "sure", "edges", "heads", "repeated"), "frames")
    columns = ["page_id", "shop", "n", "len", "tags", "linked", "kind", "words", "hash", "crumb"]

    def lines(columns, frame):
        ids, numbers = [], []
        for page_id, shop, n, length, tags, linked, kind, words, hashes, crumb, *own in zip(*columns):
            bare = furniture(kind, words, hashes, crumb, *frame(shop, own))
            for k, keep in zip(n, content_flags(length, tags, linked, bare)):
                if keep:
                    ids.append(page_id)
                    numbers.append(k)
        return ids, numbers

    if fits(sides):
        # Frames of bounded size go to every worker once; no page carries them.
        known = {r._s: tuple(frozenset(x or ()) for x in r[1:]) for r in sides.collect()}
        shared, none = pages.sparkSession.sparkContext.broadcast(known), (frozenset(),) * 4

        def alone(*columns):
            frames = shared.value
            return lines(columns, lambda shop, own: frames.get(shop, none))

        return map_columns(parsed.select(*columns), "page_id bigint, line_no int", alone)

    def beside(*columns):
        return lines(columns, lambda shop, own: tuple(frozenset(x or ()) for x in own))

    joined = parsed.join(sides, F.col("shop").eqNullSafe(F.col("_s")), "left")
    return map_columns(joined.select(*columns, "sure", "edges", "heads", "repeated"), "page_id bigint, line_no int", beside)


def found_content(raw_pages: DataFrame) -> DataFrame:
    """Distinct (page_id, line_no) of the lines of a page's own content."""
    return main_content(raw_pages).distinct()
