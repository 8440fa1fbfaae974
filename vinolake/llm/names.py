"""Variant spellings of names: pigeonhole segment join, then evidence on the rest of the name.

A name's rare words (surnames here) are looked up approximately: each lexicon
word is cut into k + 1 segments, one of which survives k edits, so a query word
that holds none of the segments at a position shifted by at most k cannot match;
the inverted index over (length, segment number, segment) finds the candidates
and a banded edit distance with transpositions verifies them. The join runs on
the distinct words of the corpus, never on records.

Which estate a record means is then decided from the words around the surname:
order, legal form and separators are free; a first name, nickname or initial
must agree with the estate's.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vinolake.functions.glyphs import skeleton
from vinolake.operators.scale import BROADCAST_BYTES, BROADCAST_ROWS, fits, map_columns, small_side, spread, written

#: Entries shorter than this only stand for themselves; shorter than MIN_LENGTH, they and their
#: misspellings count with evidence of their own; from FAR_LENGTH on, two edits are looked for.
NEAR_LENGTH, MIN_LENGTH, FAR_LENGTH = 4, 6, 8
#: A word that is not in the lexicon is a sure misspelling if it is rare: at most this
#: often, or at most this share of the entry's own frequency. Of a more frequent one
#: each record needs evidence of its own (``Book.resolve``) or the spelling needs it.
RARE, RARE_SHARE = 2, 0.12
#: A word that stands before the last one in so many names of the book is a first name.
COMMON_FIRST = 3
#: A decision's cost from which on it rests on two edits.
FAR_COST = 20
#: Entries of a word map that go to the workers as a dictionary, and rows of a book that go there whole; larger ones are joined.
MAP_ROWS, BOOK_ROWS = 150_000, 200_000

# Legal forms and their abbreviations, words that belong to no name,
# and nicknames that are not the beginning of the name.
TYPES = frozenset("domaine dom dne mas cave chateau cht chat ch maison mais mson weingut weing wgt".split())
JUNK = frozenset("la le les vigneron vignerons vigneronne vignoble vignobles earl scea gaec sarl vins vin wines nature fils filles frere freres frs pere soeurs et and und van von viticulteur nv aoc bio".split())
NICKNAMES = {"babeth": "elisabeth", "lisbeth": "elisabeth", "margot": "marguerite", "guy": "guillaume", "cathy": "catherine", "nico": "nicolas", "jf": "jean francois", "fredo": "frederic", "titi": "therese"}
FORMS = {"dom": "domaine", "dne": "domaine", "cht": "chateau", "chat": "chateau", "ch": "chateau", "mais": "maison", "mson": "maison", "weing": "weingut", "wgt": "weingut"}
# End of fixed values.

_UNIT = re.compile(r"\d[\d.,]*\s*(?:[xX]\s*\d[\d.,]*\s*)?(?:%|°|ml|cl|dl|hl|ha|ex|fl\.?\s*oz|fl|oz|bt|mois|litres?|liters?|ltr|centilitres?|m|l)?(?![a-z])\.?")
_OLD_VINES = re.compile(r"\bv\.\s?v\.?(?![a-z])")
_NO_YEAR = re.compile(r"\bs\.\s?a\.?(?![a-z])|\bmill\.")
_TOKEN = re.compile(r"[a-z]+(?:['’][a-z]+)?|[|\"“”«»‘’']|,|(?<=\s)[-–—/](?=\s)|\x00")


def tokens(text: str | None) -> list[str]:
    """Words of a title or name in order; '' where a number, bar or quote breaks it, '-' for a spaced dash, ',' for a comma."""
    return skeleton_tokens(skeleton(text))


def skeleton_tokens(s: str) -> list[str]:
    """``tokens`` of a text that is a skeleton already."""
    if not s:
        return []
    if "v." in s:
        s = _OLD_VINES.sub(" vv ", s)
    if "s." in s or "mill." in s:
        s = _NO_YEAR.sub("\x00", s)
    s = _UNIT.sub(" \x00 ", s)
    return ["" if t in "|\"“”«»‘’'\x00" else "-" if t in "-–—/" else t for t in _TOKEN.findall(s)]


def osa_within(a: str, b: str, k: int) -> int | None:
    """Edit distance with adjacent transpositions if it is at most ``k``, computed in a band of width 2k + 1; else None."""
    if abs(len(a) - len(b)) > k:
        return None
    if a == b:
        return 0
    before, last = None, {j: j for j in range(0, k + 1)}
    for i in range(1, len(a) + 1):
        row = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            if j == 0:
                row[j] = i
                continue
            d = min(last.get(j, 99) + 1, row.get(j - 1, 99) + 1, last.get(j - 1, 99) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before.get(j - 2, 99) + 1)
            row[j] = d
        if min(row.values()) > k:
            return None
        before, last = last, row
    d = last.get(len(b), 99)
    return d if d <= k else None


def _one_edit_index(words: DataFrame, by: list[str]) -> DataFrame:
    """Inverted index for one edit: the two halves and the whole word."""
    n = F.length("word")
    half = F.floor(n / 2).cast("int")
    keys = F.array(
        F.struct(n.alias("len"), F.lit(0).alias("part"), F.substring("word", F.lit(1), half).alias("seg")),
        F.struct(n.alias("len"), F.lit(1).alias("part"), F.substring("word", half + 1, n).alias("seg")),
        F.struct(n.alias("len"), F.lit(2).alias("part"), F.col("word").alias("seg")),
    )
    return words.select(*by, F.col("word").alias("entry"), F.explode(keys).alias("k")).select(*by, "entry", "k.*")


def _one_edit_probes(words: DataFrame, by: list[str]) -> DataFrame:
    """Per possible length of an entry: its first half at the start, its second half at the end; and the word with the letters around the cut swapped.

    One edit leaves one half as it is, at the start or moved by the difference
    of lengths, except a swap of the two letters on either side of the cut.
    """
    n = F.length("word")
    keys = []
    for d in (-1, 0, 1):
        m = n + d
        half = F.floor(m / 2).cast("int")
        rest = m - half
        keys.append(F.struct(m.alias("len"), F.lit(0).alias("part"), F.substring("word", F.lit(1), half).alias("seg")))
        keys.append(F.struct(m.alias("len"), F.lit(1).alias("part"), F.substring("word", n - rest + 1, rest).alias("seg")))
    half = F.floor(n / 2).cast("int")
    swapped = F.concat(F.substring("word", F.lit(1), half - 1), F.substring("word", half + 1, F.lit(1)), F.substring("word", half, F.lit(1)), F.substring("word", half + 2, n))
    keys.append(F.struct(n.alias("len"), F.lit(2).alias("part"), swapped.alias("seg")))
    return words.select(*by, "word", F.explode(F.array(*keys)).alias("k")).select(*by, "word", "k.*")


def _two_edit_index(words: DataFrame, by: list[str]) -> DataFrame:
    """Inverted index for two edits: the three thirds of a word, and the halves and the word for what a swap leaves to one edit."""
    n = F.length("word")
    a, b = F.floor(n / 3).cast("int"), F.floor(n * 2 / 3).cast("int")
    thirds = F.array(*[F.struct(n.alias("len"), F.lit(10 + p).alias("part"), seg.alias("seg")) for p, seg in enumerate((F.substring("word", F.lit(1), a), F.substring("word", a + 1, b - a), F.substring("word", b + 1, n - b)))])
    return words.select(*by, F.col("word").alias("entry"), F.explode(thirds).alias("k")).select(*by, "entry", "k.*").unionByName(_one_edit_index(words, by))


def _two_edit_probes(words: DataFrame, by: list[str]) -> DataFrame:
    """Probes of two edits: without a swap one third survives, moved by two at most; with a swap the word after swapping those letters back is within one edit."""
    at = words.select(*by, "word", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(p).alias("p"), F.lit(shift).alias("shift")) for d in range(-2, 3) for p in range(3) for shift in range(-2, 3)])).alias("x"))
    m = F.length("word") + F.col("x.d")
    cut = F.array(F.lit(0), F.floor(m / 3).cast("int"), F.floor(m * 2 / 3).cast("int"), m)
    start = F.get(cut, F.col("x.p"))
    size, begin = F.get(cut, F.col("x.p") + 1) - start, start + F.col("x.shift")
    thirds = at.where((m > 0) & (begin >= 0) & (begin + size <= F.length("word"))).select(*by, "word", m.alias("len"), (F.col("x.p") + 10).alias("part"), F.substring("word", begin + 1, size).alias("seg"))
    swaps = words.where("length(word) > 1").select(*by, F.col("word").alias("_w"), F.explode(F.expr("sequence(1, length(word) - 1)")).alias("i"))
    swapped = F.concat(F.substring("_w", F.lit(1), F.col("i") - 1), F.substring("_w", F.col("i") + 1, F.lit(1)), F.substring("_w", F.col("i"), F.lit(1)), F.substring("_w", F.col("i") + 2, F.length("_w")))
    variants = swaps.select(*by, "_w", swapped.alias("word")).where("word <> _w")
    return thirds.unionByName(_one_edit_probes(variants, [*by, "_w"]).select(*by, F.col("_w").alias("word"), "len", "part", "seg"))


def segment_join(words: DataFrame, lexicon: DataFrame, k: int = 1, by: list[str] = [], of: DataFrame | None = None) -> DataFrame:
    """Distinct (by..., word, entry, distance) of every word within ``k`` edits (1 or 2) of a lexicon entry, both columns named word.

    A transposition counts as one edit. Words are cut into k + 1 segments and
    everything up to the verification runs inside the JVM; a transposition, which can
    spoil two segments, has probes of its own. ``by`` are columns that must be equal
    (for lexicons of their own). Nulls match nothing; words of one letter only
    match themselves. Every pair within ``k`` edits is found: no caps. ``of`` is a
    table of known size that has at least the rows of the lexicon.
    """
    if k not in (1, 2):
        raise ValueError("one or two edits")
    left = words.select(*by, "word").where("word is not null and word <> ''").distinct()
    right = lexicon.select(*by, "word").where("word is not null and word <> ''").distinct()
    index, probes = (_one_edit_index(right, by), _one_edit_probes(left, by)) if k == 1 else (_two_edit_index(right, by), _two_edit_probes(left, by))
    # An entry has three index rows for one edit and six for two.
    pairs = probes.join(small_side(index, BROADCAST_ROWS // (1 if of is None else 3 * k), BROADCAST_BYTES, of), [*by, "len", "part", "seg"]).select(*by, "word", "entry").distinct()
    # A banded distance in the JVM discards nearly all candidates; what remains, transpositions among it, is verified exactly.
    near = pairs.withColumn("_l", F.levenshtein("word", "entry", 2 * k)).where("_l >= 0")
    if k == 1:
        swap = F.exists(F.expr("sequence(1, length(word) - 1)"), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.lit(1)), F.substring("word", i, F.lit(1)), F.substring("word", i + 2, F.length("word"))) == F.col("entry"))
        d = F.when(F.col("_l") < 2, F.col("_l")).when((F.length("word") == F.length("entry")) & (F.length("word") > 1), F.when(swap, 1))
        return near.select(*by, "word", "entry", d.cast("int").alias("distance")).where("distance is not null")
    near = near.drop("_l")

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa_within(x, y, k) for x, y in zip(a.tolist(), b.tolist())], dtype="Int32")

    return near.withColumn("distance", distance("word", "entry")).where("distance is not null")


def tokenized(records: DataFrame) -> DataFrame:
    """(source, record_id, name, title) with both texts as tokens with a space between; one row per row, written once.

    Repeated rows stay (a shuffle of all texts would cost more than to parse
    them again); what is decided for a record is merged at the end. A name equal to
    the shop's own name is no name.
    """
    rows = records.select("source", "record_id", F.when(F.lower("name") == F.lower("shop"), None).otherwise(F.col("name")).alias("name"), "title").where("record_id is not null")

    def parse(source, record_id, name, title):
        return source, record_id, [" ".join(tokens(x)) for x in name], [" ".join(tokens(x)) for x in title]

    return written(map_columns(spread(rows, 1), "source string, record_id bigint, name string, title string", parse), "tokens")


def word_counts(tok: DataFrame) -> DataFrame:
    """(word, n, n_name): in how many rows a word stands, and in how many as part of the name."""
    both = F.array_distinct(F.split(F.concat_ws(" ", "name", "title"), " "))
    words = tok.select(F.explode(F.filter(both, lambda w: F.length(w) >= 2)).alias("word"), F.concat(F.lit(" "), "name", F.lit(" ")).alias("name"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.contains("name", F.concat(F.lit(" "), "word", F.lit(" ")))).alias("n_name"))


def weighed(found: DataFrame, counts: DataFrame, lexicon: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``found`` (word, entry, distance) with n, n_name, the entry's n_entry and whether the word is an entry itself; other entries drop out.

    Entries are looked up as an outer side: one may occur in the corpus only misspelt.
    """
    entries = lexicon.select(F.col("word").alias("entry")).distinct()
    weight = entries.join(counts.select(F.col("word").alias("entry"), F.col("n").alias("n_entry")), "entry", "left")
    near = found.join(counts, "word").join(small_side(weight, BROADCAST_ROWS, BROADCAST_BYTES, of), "entry").join(small_side(entries.select(F.col("entry").alias("word"), F.lit(True).alias("is_entry")), BROADCAST_ROWS, BROADCAST_BYTES, of), "word", "left")
    return near.where((F.col("distance") == 0) | F.col("is_entry").isNull()).withColumn("n_entry", F.coalesce("n_entry", F.lit(0)))


def word_map(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, entry, distance): the lexicon entry each corpus word stands for; entries stand for themselves.

    A word that is no entry is a misspelling only if it is rare beside the
    entry; of several entries the nearest, most frequent one is taken. Entries
    shorter than MIN_LENGTH only stand for themselves. ``lexicon`` is a written table.
    """
    long = lexicon.where(F.length("word") >= MIN_LENGTH)
    found = segment_join(counts.where(F.length("word") >= MIN_LENGTH - 1), long, of=lexicon)
    rare = (F.col("n") <= RARE) | (F.col("n") <= RARE_SHARE * F.col("n_entry"))
    good = weighed(found, counts, long, lexicon).where((F.col("distance") == 0) | rare)
    best = good.groupBy("word").agg(F.min(F.struct(F.col("distance"), -F.col("n_entry"), F.col("entry"))).alias("b"))
    short = lexicon.where(F.length("word") < MIN_LENGTH).select("word", F.col("word").alias("entry"), F.lit(0).alias("distance")).distinct()
    return best.select("word", F.col("b.entry").alias("entry"), F.col("b.distance").alias("distance")).join(short.select("word"), "word", "left_anti").unionByName(short)


def near_words(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, entry, distance, behind): every lexicon entry a corpus word may stand for; entries stand for themselves.

    The edits that are looked for grow with the entry: none under NEAR_LENGTH
    letters, one from there on, and two from FAR_LENGTH on for words that have no nearer
    entry. Nothing within one edit is left out; two edits need a word that is rare
    itself and stands alone. behind says how frequency speaks: 0 for
    the nearest, most frequent entry, 1 for its rivals, and 2 more where the word
    is not rare beside the entry or the likeness alone says little (short entries, two edits).
    """
    near = lexicon.where(F.length("word") >= NEAR_LENGTH)
    one = written(weighed(segment_join(counts.where(F.length("word") >= NEAR_LENGTH - 1), near, of=lexicon), counts, near, lexicon), "near")
    rest = counts.where(F.length("word") >= FAR_LENGTH - 2).join(one.select("word"), "word", "left_anti")
    far = lexicon.where(F.length("word") >= FAR_LENGTH)
    # At two edits a word that stands in names again and again is another maker's, and so is one within one edit of such a word.
    two = written(weighed(segment_join(rest.where(F.col("n") <= RARE), far, 2, of=lexicon).where("distance = 2"), counts, far, lexicon), "far")
    others = segment_join(two.select("word"), counts.where((F.col("n_name") > RARE) & (F.length("word") >= FAR_LENGTH - 2))).select("word").distinct()
    two = two.join(others, "word", "left_anti")
    often = (F.col("distance") > 0) & ((F.col("n") > RARE) & (F.col("n") > RARE_SHARE * F.col("n_entry")) | (F.length("entry") < MIN_LENGTH) | (F.col("distance") > 1))
    first = Window.partitionBy("word").orderBy("distance", F.desc("n_entry"), "entry")
    behind = F.when(F.row_number().over(first) == 1, 0).otherwise(1) + F.when(often, 2).otherwise(0)
    short = lexicon.where(F.length("word") < NEAR_LENGTH).select("word", F.col("word").alias("entry"), F.lit(0).alias("distance"), F.lit(0).alias("behind")).distinct()
    return one.unionByName(two).select("word", "entry", "distance", behind.cast("int").alias("behind")).unionByName(short)


HIT = "array<struct<field:int,pos:int,entry:string,distance:int,behind:int>>"


def with_decisions(tok: DataFrame, mapping: DataFrame, keep: list[str], decide, columns: str, extra: list[str] = []) -> DataFrame:
    """The columns ``keep`` of ``tok`` with those of the rows that ``decide(name, title, hits, *extra)`` gives, in one Python stage.

    hits are (field, pos, entry, distance, behind), field 0 being the name and 1 the
    title; a word may have several entries in ``mapping``, and behind is 0 where it has no such
    column. A map of bounded size goes to the workers; a larger one is joined on the words.
    """
    schema = T.StructType([*[tok.schema[c] for c in keep], *T.StructType.fromDDL(columns).fields])
    few = fits(mapping, MAP_ROWS)
    if few:
        entries: dict[str, list[tuple[str, int, int]]] = {}
        for r in mapping.toLocalIterator():
            entries.setdefault(r.word, []).append((r.entry, r.distance, r.behind if "behind" in mapping.columns else 0))
        known = tok.sparkSession.sparkContext.broadcast(entries)
    else:
        parts = F.explode(F.array(F.struct(F.lit(0).alias("field"), F.split("name", " ").alias("ws")), F.struct(F.lit(1).alias("field"), F.split("title", " ").alias("ws"))))
        # Equal texts have equal hits: a hash of the texts is the key, so repeated texts are joined once.
        keyed = tok.withColumn("_h", F.xxhash64("name", "title"))
        mapping = mapping if "behind" in mapping.columns else mapping.withColumn("behind", F.lit(0))
        words = keyed.select("_h", parts.alias("p")).select("_h", "p.field", F.posexplode("p.ws").alias("pos", "word")).distinct()
        hits = words.join(mapping, "word").groupBy("_h").agg(F.collect_list(F.struct("field", "pos", "entry", "distance", "behind")).alias("hits"))
        tok = keyed.join(hits, "_h", "left").drop("_h").withColumn("hits", F.coalesce("hits", F.array().cast(HIT)))

    def run(name, title, *rest):
        kept, more = rest[: len(keep)], rest[len(keep) :]
        m = known.value if few else {}
        rows: list[tuple] = []
        for k, (n, t) in enumerate(zip(name, title)):
            n, t = n.split(" ") if n else [], t.split(" ") if t else []
            if few:
                hits = [(f, at, *x) for f, ws in ((0, n), (1, t)) for at, w in enumerate(ws) if w in m for x in m[w]]
            else:
                hits = [tuple(h.values()) for h in more[-1][k]]
            for r in decide(n, t, hits, *[c[k] for c in more[: len(extra)]]):
                rows.append((*[c[k] for c in kept], *r))
        return zip(*rows) if rows else [[] for _ in schema]

    return map_columns(tok.select("name", "title", *keep, *extra, *([] if few else ["hits"])), schema, run)


class Book:
    """The estates of a name book by surname, and what counts as a first name.

    ``firsts`` and ``whole`` are the words and the whole of the first names of a larger book of which these are some estates.
    """

    def __init__(self, names: list[tuple[int, str]], firsts: frozenset[str] | None = None, whole: list[str] | None = None):
        parsed = [(i, [w for w in tokens(n) if w.isalpha()]) for i, n in names]
        bare = [(i, [w for w in ws if w not in TYPES and w not in JUNK], any(w in ("et",) for w in ws) or bool(re.search(r"[&]|\w-\w", n))) for (i, ws), (_, n) in zip(parsed, names)]
        if firsts is None:
            leading = Counter(w for _, ws, _ in bare for w in set(ws[:-1]))
            firsts = frozenset(w for w, n in leading.items() if n >= COMMON_FIRST) | frozenset("jean francois".split())
        self.firsts = firsts
        self.estates: list[tuple[int, tuple[str, ...], str]] = []
        self.forms: list[frozenset[str]] = []
        for (i, ws, _), (_, full) in zip(bare, parsed):
            first = " ".join(w for w in ws[:-1] if w in self.firsts)
            last = tuple(w for k, w in enumerate(ws) if k == len(ws) - 1 or w not in self.firsts)
            if last:
                self.estates.append((i, last, first))
                self.forms.append(frozenset(FORMS.get(w, w) for w in full if w in TYPES))
        self.by: dict[str, list[int]] = defaultdict(list)
        for k, (_, last, _) in enumerate(self.estates):
            for w in set(last):
                self.by[w].append(k)
        self.whole = sorted({f for _, _, f in self.estates if f}) if whole is None else whole
        self._first: dict[str, bool] = {}

    def surnames(self) -> list[str]:
        return sorted(self.by)

    def strength(self, word: str, first: str) -> int:
        """0 if a word cannot stand for a first name, 1 for an initial, 2 for an abbreviation, 3 for the name."""
        parts = first.split(" ")
        if word == first or word in parts or len(word) >= 5 and any(osa_within(word, p, 1) is not None for p in parts):
            return 3
        if NICKNAMES.get(word) == first:
            return 2
        if any(p.startswith(word) for p in parts):
            return 1 if len(word) == 1 else 2
        return 0

    def first_like(self, word: str) -> bool:
        if word not in self._first:
            if len(self._first) > 500_000:
                self._first.clear()
            self._first[word] = any(self.strength(word, f) for f in self.whole)
        return self._first[word]

    def evidence(self, ws: list[str], spots: list[int], whole_field: bool) -> list[str]:
        """First names, nicknames and initials around the surnames at ``spots``."""
        if not spots:
            return []
        if whole_field:
            taken = set(spots)
            beside = {k for s in spots for k in (s - 1, s + 1)} | {k for s in spots for k in (s - 2, s + 2) if 0 <= k < len(ws) and ws[(k + s) // 2] == ","}
            # a first name, or a word right beside the surname that could only be one the book does not know
            return [w for k, w in enumerate(ws) if k not in taken and w.isalpha() and w not in TYPES and w not in JUNK and (self.first_like(w) or k in beside and len(w) >= 4 and w not in self.by)]
        out = []
        for at, step in ((min(spots), -1), (max(spots), 1)):
            k = at + step
            while 0 <= k < len(ws):
                w = ws[k]
                if w in TYPES or w in JUNK or w == ",":
                    k += step
                    continue
                if w.isalpha() and self.first_like(w):
                    out.append(w)
                    k += step
                    continue
                break
        return out

    def signs(self, name: list[str], title: list[str], at: dict, words: set[str]) -> list[str]:
        return [x for f, ws in ((0, name), (1, title)) for x in self.evidence(ws, [h[0] for w in words for h in at[f].get(w, [])], f == 0)]

    def agreed(self, e: int, cost: int, signs: list[str]) -> tuple[int, int, int] | None:
        """(rank, cost, estate) if the signs agree with the estate or it needs none."""
        _, last, first = self.estates[e]
        if len(last) > 1:
            return (0, cost, e)
        if not first:
            return None if any(len(w) >= 3 for w in signs) else (1, cost, e)
        if signs:
            long = [w for w in signs if len(w) > 1]
            fits = [self.strength(w, first) for w in signs]
            return (-max(fits), cost, e) if max(fits) >= 2 or max(fits) == 1 and not long else None
        return (1, cost, e) if sum(len(self.estates[x][1]) == 1 for x in self.by[last[0]]) == 1 else None

    def formed(self, e: int, name: list[str], title: list[str], at: dict) -> bool:
        """Whether the estate's own legal form stands right beside its surname."""
        word = self.estates[e][1][0]
        return any(0 <= j < len(ws) and FORMS.get(ws[j], ws[j]) in self.forms[e] for f, ws in ((0, name), (1, title)) for k, *_ in at[f].get(word, []) for j in (k - 1, k + 1))

    def vague(self, e: int, at: dict) -> bool:
        """Whether the estate has only short surnames and they stand in no name field: they may be any words of a title."""
        last = self.estates[e][1]
        return all(len(w) < MIN_LENGTH for w in last) and not all(w in at[0] for w in last)

    def placed(self, e: int, name: list[str], title: list[str], at: dict) -> bool:
        """Whether the estate's legal form, or its next surname, stands right beside a surname."""
        last = self.estates[e][1]
        if len(last) == 1:
            return self.formed(e, name, title, at)
        return all(any(abs(j - k) <= 2 for j, *_ in at[1].get(a, []) for k, *_ in at[1].get(b, [])) for a, b in zip(last, last[1:]))

    @staticmethod
    def best(agreed: list[tuple[int, int, int]]) -> int | None:
        agreed.sort(key=lambda x: (x[1] // 10, x[0], x[1]))
        if not agreed or len(agreed) > 1 and agreed[0][:2] == agreed[1][:2]:
            return None  # none fits, or two estates fit equally well
        return agreed[0][2]

    def resolve(self, name: list[str], title: list[str], hits: list[tuple]) -> tuple[int, int] | None:
        """(producer_id, edits) of the estate a record means by its own evidence, or None. Hits are (field, pos, entry, distance[, behind])."""
        return self.resolve_noted(name, title, hits)[0]

    def resolve_noted(self, name: list[str], title: list[str], hits: list[tuple]) -> tuple[tuple[int, int] | None, list[tuple[str, int, int, int]]]:
        """``resolve``, and what the record says of each frequent misspelling in it: (word, verdict, producer_id or -1, edits).

        A frequent misspelling counts only with a first name, the partner's surname
        or the legal form that the estate bears. The verdict is 1 if the record so
        shows that it stands for the estate, -1 if it shows another maker, 0 if it
        is open; an open record has the only estate it can mean.
        """
        if not hits:
            return None, []
        at: dict[int, dict[str, list[tuple[int, int, int]]]] = {0: defaultdict(list), 1: defaultdict(list)}
        for f, k, w, d, *behind in hits:
            at[f][w].append((k, d, behind[0] if behind else 0))
        found: dict[int, int] = {}
        for f in (0, 1):
            for w in at[f]:
                for e in self.by[w]:
                    last = self.estates[e][1]
                    if all(x in at[f] for x in last):
                        nearest = [min(h[1:] for h in at[f][x]) for x in last]
                        cost = sum(d for d, _ in nearest) * 10 + f + 2 * max(b for _, b in nearest) + any(len(x) < MIN_LENGTH for x in last) - 100 * (len(last) - 1)
                        found[e] = min(found.get(e, cost), cost)
        if not found:
            return None, []
        often = {w for f in (0, 1) for w, hs in at[f].items() if min(h[2] for h in hs) >= 2} - {w for f in (0, 1) for w, hs in at[f].items() if min(h[2] for h in hs) < 2}
        weak = {e for e in found if len(self.estates[e][1]) == 1 and self.estates[e][1][0] in often}
        sure = [e for e in found if e not in weak]
        vague = {e for e in sure if self.vague(e, at)}
        signs = self.signs(name, title, at, {x for e in sure if e not in vague for x in self.estates[e][1]})
        fit = [a for e in sure if e not in vague and (a := self.agreed(e, found[e], signs))]
        for e in vague:
            a = self.agreed(e, found[e], self.signs(name, title, at, set(self.estates[e][1])))
            if a and (a[0] < 0 or self.placed(e, name, title, at)):
                fit.append(a)
        chosen = self.best(fit)
        spelt: dict[str, set[str]] = defaultdict(set)
        for f, ws in ((0, name), (1, title)):
            for w, hs in at[f].items():
                for k, _, b in hs:
                    if b >= 2:
                        spelt[w].add(ws[k])
        if not spelt:
            return (None if chosen is None else (self.estates[chosen][0], found[chosen])), []
        proven, open_, verdict = [], [], {w: 0 for w in spelt}
        if chosen is not None:
            verdict = {w: 1 if w in self.estates[chosen][1] else -1 for w in spelt}
        else:
            for w in sorted({self.estates[e][1][0] for e in weak}):
                own = self.signs(name, title, at, {w})
                fits = [(e, a) for e in self.by[w] if e in weak and (a := self.agreed(e, found[e], own))]
                shown = [a for e, a in fits if own and a[0] < 0 or not self.estates[e][2] and self.formed(e, name, title, at)]
                verdict[w] = 1 if shown else 0 if fits or not own else -1
                proven += shown
                open_ += [a for _, a in fits] if not shown else []
            chosen = self.best(proven)
        left = self.best(open_) if chosen is None and len(sure) == len(vague) and not proven else None
        notes = []
        for w, words in spelt.items():
            mine = left is not None and self.estates[left][1][0] == w
            notes += [(x, verdict[w], self.estates[left][0] if mine else -1, found[left] if mine else 0) for x in sorted(words)]
        return (None if chosen is None else (self.estates[chosen][0], found[chosen])), notes


class Shelf:
    """A name book for the workers: whole if it is of bounded size, else only its first names, the estates being joined to the records."""

    def __init__(self, book: DataFrame):
        rows = book.select("producer_id", "name").where("producer_id is not null and name is not null").distinct()
        spark, self.book = book.sparkSession, None
        listed = rows.orderBy("producer_id").limit(BOOK_ROWS + 1).collect()
        if len(listed) <= BOOK_ROWS:
            self.book = Book([(r.producer_id, r.name) for r in listed])
            self.lexicon = spark.createDataFrame([(w,) for w in self.book.surnames()], "word string")
            self.lexicon._vinolake_size = (len(self.book.by), sum(len(w) + 16 for w in self.book.by))
            self.shared = spark.sparkContext.broadcast(self.book)
            return

        def leading(batches):
            for b in batches:
                ws = [[w for w in tokens(n) if w.isalpha() and w not in TYPES and w not in JUNK] for n in b["name"]]
                yield pd.DataFrame({"word": pd.Series([w for x in ws for w in set(x[:-1])], dtype=object)})

        common = rows.select("name").mapInPandas(leading, "word string").groupBy("word").count().where(F.col("count") >= COMMON_FIRST)
        firsts = frozenset(r.word for r in common.collect()) | frozenset("jean francois".split())  # first names of a language are few

        def parts(batches):
            for b in batches:
                out = []
                for i, n in zip(b["producer_id"], b["name"]):
                    for _, last, first in Book([(i, n)], firsts, []).estates:
                        out += [(i, n, first, w) for w in set(last)]
                yield pd.DataFrame({"producer_id": pd.Series([r[0] for r in out], dtype="int64"), **{c: pd.Series([r[k] for r in out], dtype=object) for k, c in ((1, "name"), (2, "first"), (3, "word"))}})

        self.parts = written(rows.select(F.col("producer_id").cast("long").alias("producer_id"), "name").mapInPandas(parts, "producer_id bigint, name string, first string, word string"), "book")
        whole = sorted(r.first for r in self.parts.where("first <> ''").select("first").distinct().collect())
        self.lexicon = written(self.parts.select("word").distinct(), "surnames")
        self.shared = spark.sparkContext.broadcast(Book([], firsts, whole))

    def known(self) -> Book:
        """The book, or an empty one that knows the first names."""
        return self.shared.value

    def with_estates(self, tok: DataFrame, mapping: DataFrame) -> DataFrame:
        """``tok`` with estates: the (producer_id, name) of all estates whose surname a word of the row may stand for."""
        keyed = tok.withColumn("_t", F.xxhash64("name", "title"))
        words = keyed.select("_t", F.explode(F.split(F.concat_ws(" ", "name", "title"), " ")).alias("word")).distinct()
        entries = words.join(mapping.select("word", "entry"), "word").select("_t", F.col("entry").alias("word")).distinct()
        mine = entries.join(self.parts.select("word", "producer_id", F.col("name").alias("_n")), "word").groupBy("_t").agg(F.collect_set(F.struct("producer_id", F.col("_n").alias("name"))).alias("estates"))
        return keyed.join(mine, "_t", "left").drop("_t").withColumn("estates", F.coalesce("estates", F.array().cast("array<struct<producer_id:bigint,name:string>>")))


def link_names(records: DataFrame, book: DataFrame) -> DataFrame:
    """(source, record_id, producer_id) for records (source, record_id, shop, name, title) that mean an estate of ``book`` (producer_id, name).

    One row per record at most. Null and empty names leave the decision to the
    title and the reverse; a record whose evidence fits two estates equally, or
    contradicts the only one, gives none. Repeated rows are merged. A book of any
    size is linked: beyond BOOK_ROWS its estates are joined to the records by surname.
    """
    shelf = Shelf(book)
    tok = tokenized(records)
    counts = written(word_counts(tok), "words")
    mapping = written(near_words(counts, shelf.lexicon), "map")
    shared, whole = shelf.shared, shelf.book is not None

    def decide(name, title, hits, estates=None):
        b = shared.value if whole else Book([(e["producer_id"], e["name"]) for e in sorted(estates, key=lambda e: e["producer_id"])], shared.value.firsts, shared.value.whole)
        got, notes = b.resolve_noted(name, title, hits)
        return [*([(*got, "", 1)] if got is not None else []), *[(p, d, w, v) for w, v, p, d in notes]]

    columns = "producer_id bigint, edits int, word string, verdict int"
    if whole:
        decided = with_decisions(tok, mapping, ["source", "record_id"], decide, columns)
    else:
        decided = with_decisions(shelf.with_estates(tok, mapping), mapping, ["source", "record_id"], decide, columns, ["estates"])
    linked = written(decided, "linked")
    # An open record follows the others that hold its spelling: more distinct records for the estate than against it, or (at one edit) hardly any at all.
    spelling = linked.where("word <> ''").groupBy("word", "source", "record_id").agg(F.max("verdict").alias("v")).groupBy("word").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    trusted = spelling.where((F.col("v") > 0) | (F.col("v") == 0) & (F.col("n") <= RARE)).select("word", (F.col("v") > 0).alias("proven"))
    followed = linked.where("word <> '' and verdict = 0 and producer_id >= 0").join(small_side(trusted), "word").where(F.col("proven") | (F.col("edits") < FAR_COST)).drop("proven")
    linked = linked.where("word = ''").unionByName(followed.select(linked.columns))
    # A record delivered with different texts is decided by its best reading.
    return linked.groupBy("source", "record_id").agg(F.min(F.struct("edits", "producer_id")).alias("b")).select("source", "record_id", F.col("b.producer_id").alias("producer_id"))


def found_names(listing: DataFrame, shopify_product: DataFrame, book: DataFrame) -> DataFrame:
    """Distinct (source, record_id, producer_id) of listings and products made by an estate of the book."""
    a = listing.select(F.lit("listing").alias("source"), F.col("listing_id").cast("long").alias("record_id"), "shop", F.col("producer").alias("name"), "title")
    b = shopify_product.select(F.lit("shopify_product").alias("source"), F.col("product_id").cast("long").alias("record_id"), "shop", F.col("vendor").alias("name"), "title")
    return link_names(a.unionByName(b), book)
