"""Product listings describing the same item: reliable keys, then guarded connected components.

Every listing is reduced to the parts that make an item: maker, cuvee, colour,
vintage, bottle size and number of bottles. Makers and cuvees are words shops
misspell, so they are first brought to the corpus's own dominant spelling by a
segment join (makers over all words of name fields, cuvee words within their
maker). A cuvee is the set of the words of a title that are left when what names the
maker, the colour and the like, and words that many makers share, are gone.
Article numbers with a valid check digit, and part numbers of a maker, join listings
whose words differ: the keys that bear one number are split into classes of
agreeing stated parts, and a key with unknown parts joins a class only if exactly one fits.
What is so joined is grouped by connected components over item keys, not over records.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinolake.functions.glyphs import skeleton
from vinolake.llm.names import JUNK, MIN_LENGTH, NICKNAMES, RARE, RARE_SHARE, TYPES, Book, Shelf, osa_within, segment_join, skeleton_tokens, tokens, with_decisions, word_counts, word_map
from vinolake.operators.components import components
from vinolake.operators.scale import BROADCAST_BYTES, BROADCAST_ROWS, map_columns, rows_of, small_side, spread, written
from vinolake.operators.units import BOX_WORDS, COUNT_WORDS, skeleton_ml

# Colour words; words of titles that name neither maker nor cuvee.
COLOURS = {
    "red": "rouge rge red rood rot rosso tinto".split(),
    "white": "blanc bl white wit weiss bianco blanco".split(),
    "rose": "rose rosado rosato".split(),
    "orange": "orange oranje maceration skin contact".split(),
}
COMMON = frozenset(
    "cuvee clos cote cotes sous en au aux le la les l d de du des mill millesime sans nv mis vin vins vino wine nature bio aoc igp dop vv vieilles vieille vignes vigne"
    " magnum mag jeroboam double demie demi bouteille bouteilles half bottle clavelin bag box bib coffret carton caisse case doos of trois six lot base parcelle tirage ex"
    " raisin altitude eleve mois soufre ajoute promo top nouveau bestseller rare arrivage exclusivite web coup coeur dernieres default title litre litres liter ltr cl ml dl oz fl centilitres vol ha".split()
)
# End of fixed values.
_COLOUR = {w: c for c, ws in COLOURS.items() for w in ws}
#: A word that stands beside this share of all makers (and so many at least) is common, unless it is all that tells a maker's titles apart.
COMMON_SHARE, COMMON_LEAST = 0.02, 12
#: A spelling of a cuvee word is a misspelling of a neighbour that the maker's listings have so many times more often.
DOMINANT = 2
#: Records of an item beyond which its pairs are made in several tasks.
ITEM_ROWS = 2_000

_YEAR = re.compile(r"(?<![\w.,])((?:19[5-9]|20[0-4])\d)(?![\w]|[.,]\d)(?!\s*(?:ml|cl|ex|m\b))")
_SHORT_YEAR = re.compile(r"(?<!\w)['’‘](\d\d)(?!\d)")
_BOTTLED = re.compile(r"(?:mis en|bottled in|abgefullt|gebotteld in)\s+(?:19|20)\d\d")
_PACKS = [
    re.compile(r"(?<![\w.,])(\d{1,2})\s*x\s*(?=\d)"),
    re.compile(rf"(?:{BOX_WORDS})\s*(?:de|of|van|a|mit)?\s*(\d{{1,2}}|{'|'.join(COUNT_WORDS)})(?![\w.,]*\d|\s*(?:cl|ml|dl|l)\b)"),
    re.compile(r"(?<![\w.,])(\d{1,2})\s*(?:bouteilles|bottles|flessen|flaschen|fl\.)(?!\s*oz)"),
]
_DIGITS = re.compile(r"(?<!\d)(\d{8}|\d{12,14})(?!\d)")
_NUMBERED = re.compile(r"\d{8}|(?<![a-z])(?:ref|art|sku|mpn|part)")
_DATE = re.compile(r"(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d")
_PART = re.compile(r"(?<![a-z])(?:ref|art|artikel|article|sku|mpn|part)\b[\s.:#]*(?:n[or°]?[\s.:]+)?((?=[a-z0-9/-]*\d)[a-z0-9][a-z0-9/-]{3,19})(?![\w/-])")


def valid_gtin(code: str) -> bool:
    """Whether a GTIN-8, -12, -13 or -14 has the right check digit."""
    if len(code) not in (8, 12, 13, 14) or not code.isdigit() or not int(code):
        return False
    weights = [3 if k % 2 == 0 else 1 for k in range(len(code) - 1)][::-1] if len(code) % 2 == 0 else [1 if k % 2 == 0 else 3 for k in range(len(code) - 1)]
    return (10 - sum(int(c) * w for c, w in zip(code, weights)) % 10) % 10 == int(code[-1])


def gtin(text: str | None) -> str | None:
    """The only valid article number in a text, as 14 digits; None if there is none or more than one. Eight digits that read as a date are none."""
    found = {c.zfill(14) for c in _DIGITS.findall(text or "") if valid_gtin(c) and not (len(c) == 8 and _DATE.fullmatch(c))}
    return found.pop() if len(found) == 1 else None


def part_number(text: str) -> str | None:
    """The only labelled part number (ref., art. no., sku ...) of a folded text, without separators; None if there is none or more than one."""
    found = {re.sub(r"[/-]", "", c) for c in _PART.findall(text)}
    return found.pop() if len(found) == 1 else None


def vintage(text: str) -> int:
    """The vintage a folded title states in full or as 'yy; 0 if none. Years of bottling do not count."""
    s = _BOTTLED.sub(" ", text)
    m = _YEAR.search(s)
    if m:
        return int(m.group(1))
    m = _SHORT_YEAR.search(s)
    return 0 if not m else (2000 if int(m.group(1)) < 50 else 1900) + int(m.group(1))


def pack_size(text: str) -> int:
    """How many bottles a folded title sells together; 1 unless it says so."""
    for k, pattern in enumerate(_PACKS):
        if k == 0 and "x" not in text:
            continue
        if m := pattern.search(text):
            n = COUNT_WORDS.get(m.group(1)) or int(m.group(1))
            if 1 <= n <= 24:
                return n
    return 1


def colour(words: list[str]) -> str:
    for w in words:
        if w in _COLOUR:
            return _COLOUR[w]
    return ""


def _parsed(listing: DataFrame) -> DataFrame:
    def parse(record_id, names, titles, variants):
        rows = []
        for name, title, variant in zip(names, titles, variants):
            a, b = skeleton(title), skeleton(variant)
            s = f"{a} | {b}" if b else a
            ws = skeleton_tokens(s)
            ml = skeleton_ml(b) or skeleton_ml(a) or 750.0
            numbered = _NUMBERED.search(s) is not None
            rows.append((" ".join(tokens(name)), " ".join(ws), colour(ws), vintage(s), int(round(ml / 5) * 5), pack_size(s), gtin(s) if numbered else None, part_number(s) if numbered else None))
        return record_id, *zip(*rows)

    return written(map_columns(spread(listing, 1), "record_id bigint, name string, title string, colour string, vintage int, ml int, pack int, gtin string, part string", parse), "items")


def surname_lexicon(counts: DataFrame, shelf: Shelf) -> DataFrame:
    """Surnames of the book, and of other makers as their name fields spell them: words of names that are no rare neighbour of a frequent one."""
    shared = shelf.shared
    common = TYPES | JUNK | COMMON | frozenset(NICKNAMES)

    @F.pandas_udf("boolean")
    def plain(words: pd.Series) -> pd.Series:
        b = shared.value
        return pd.Series([w.isalpha() and len(w) >= 3 and w not in common and w not in _COLOUR and w not in b.firsts and not b.first_like(w) and not any(abs(len(w) - len(f)) <= 1 and osa_within(w, f, 1) is not None for f in b.firsts) for w in words.tolist()], dtype=bool)

    candidates = written(counts.where("n_name >= 1").where(plain("word")), "candidates")
    strong = candidates.where((F.col("n_name") > RARE) & (F.length("word") >= MIN_LENGTH))
    known = written(strong.select("word").union(shelf.lexicon.where(F.length("word") >= MIN_LENGTH)).distinct(), "known")
    near = segment_join(candidates.where(F.length("word") >= MIN_LENGTH - 1), known, of=known).where("distance > 0")
    weights = candidates.select(F.col("word").alias("entry"), F.col("n").alias("n_entry"))
    worse = near.join(candidates.select("word", "n"), "word").join(weights, "entry", "left").where((F.col("n") <= RARE) | (F.col("n") <= RARE_SHARE * F.coalesce("n_entry", F.lit(0))))
    return candidates.join(worse.select("word").distinct(), "word", "left_anti").select("word").union(shelf.lexicon).distinct()


def maker_spots(name: list[str], title: list[str], hits: list[tuple], book: Book) -> tuple[str, list[str]]:
    """(maker, other words of the title). A short maker word counts in a title only beside a legal form or first name, or if the name field has it too."""
    named = {h[2] for h in hits if h[0] == 0}
    spots, entries = set(), set(named)
    for f, at, entry, *_ in hits:
        if f == 1:
            beside = [w for k in (at - 1, at + 1) if 0 <= k < len(title) for w in [title[k]]]
            if len(entry) >= MIN_LENGTH or entry in named or any(w in TYPES or len(w) > 1 and book.first_like(w) for w in beside):
                spots.add(at)
                entries.add(entry)
    own = dict.fromkeys(w for k, w in enumerate(title) if k not in spots and len(w) > 1 and w.isalpha() and w not in _NO_CUVEE and not book.first_like(w))
    return " ".join(sorted(entries)), sorted(own)


_NO_CUVEE = COMMON | TYPES | JUNK | frozenset(_COLOUR)


def cuvee_keys(rows: DataFrame) -> DataFrame:
    """``rows`` (maker, own, ...) with cuvee: the words of ``own`` that tell the maker's items apart, in the maker's dominant spelling, sorted.

    Words beside many makers (grapes, regions, marketing) and their rare misspellings
    are left out, but for titles that have no other word. Everything is decided on the distinct (maker, own), and words are counted over all rows.
    """
    keyed = rows.withColumn("kind", F.when((F.col("maker") != "") & (F.size("own") > 0), F.xxhash64("maker", "own")))
    kinds = written(keyed.where("kind is not null").groupBy("kind", "maker", "own").agg(F.count("*").alias("n")), "kinds")
    each = kinds.select("kind", "maker", F.explode("own").alias("word"), "n")
    words = written(each.groupBy("maker", "word").agg(F.sum("n").alias("n")), "cuvees")
    makers = words.agg(F.count_distinct("maker")).first()[0]
    spread_over = written(words.groupBy("word").agg(F.count("*").alias("makers")), "spread")
    common = written(spread_over.where(F.col("makers") >= max(COMMON_LEAST, COMMON_SHARE * makers)).select("word"), "common")
    rare = spread_over.where((F.col("makers") <= 2) & (F.length("word") >= 5)).select("word")
    misspelt = segment_join(rare, common.where("length(word) >= 5"), of=common).where("distance > 0").select("word")
    noise = written(common.union(misspelt).distinct(), "noise")
    telling = written(words.join(small_side(noise), "word", "left_anti"), "telling")
    counts = telling.where("length(word) >= 4").select("maker", "word")
    near = segment_join(counts, counts, by=["maker"], of=telling).where("distance > 0")
    entry = telling.select("maker", F.col("word").alias("entry"), F.col("n").alias("n_entry"))
    # Of two spellings the far more frequent one is meant; of two rare ones the first in the alphabet if neither is more frequent.
    less = (F.col("n") * DOMINANT <= F.col("n_entry")) | ((F.col("n") <= RARE) & ((F.col("n") < F.col("n_entry")) | (F.col("n") == F.col("n_entry")) & (F.col("entry") < F.col("word"))))
    better = near.join(telling, ["maker", "word"]).join(entry, ["maker", "entry"]).where(less)
    best = written(better.groupBy("maker", "word").agg(F.max(F.struct("n_entry", "entry")).alias("b")).select("maker", "word", F.col("b.entry").alias("entry")), "spellings")
    # a neighbour that is itself a misspelling leads on to what it stands for
    onward = best.select("maker", F.col("word").alias("entry"), F.col("entry").alias("_next"))
    best = written(best.join(small_side(onward, BROADCAST_ROWS, BROADCAST_BYTES, best), ["maker", "entry"], "left").select("maker", "word", F.coalesce("_next", "entry").alias("entry")), "spelt")
    told = each.join(small_side(noise), "word", "left_anti").join(small_side(best), ["maker", "word"], "left").select("kind", F.coalesce("entry", "word").alias("word"))
    keys = told.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("cuvee"))
    named = written(kinds.select("kind", "own").join(keys, "kind", "left").select("kind", F.coalesce("cuvee", F.array_join("own", " ")).alias("cuvee")), "keys")
    return keyed.join(small_side(named), "kind", "left").withColumn("cuvee", F.coalesce("cuvee", F.lit(""))).drop("own", "kind")


def listing_items(listing: DataFrame, book: DataFrame) -> DataFrame:
    """(record_id, maker, cuvee, colour, vintage, ml, pack, gtin, part) per listing (listing_id, shop, producer, title, variant_title).

    maker is '' where no word of name or title is a maker's, cuvee '' where the
    title has no word of its own, vintage 0 where none is stated, ml 750 where
    no size is. Repeated rows give repeated rows.
    """
    rows = listing.select(F.col("listing_id").cast("long").alias("record_id"), F.when(F.lower("producer") == F.lower("shop"), None).otherwise(F.col("producer")).alias("name"), "title", "variant_title").where("record_id is not null")
    parsed = _parsed(rows)
    counts = written(word_counts(parsed), "words")
    shelf = Shelf(book)
    surnames = written(surname_lexicon(counts, shelf), "makers")
    mapping = written(word_map(counts, surnames), "map")
    shared = shelf.shared

    def decide(name, title, hits):
        return [maker_spots(name, title, hits, shared.value)]

    made = with_decisions(parsed, mapping, ["record_id", "colour", "vintage", "ml", "pack", "gtin", "part"], decide, "maker string, own array<string>")
    out = cuvee_keys(written(made, "made"))
    # Whether any number is stated at all, read from two columns of the parsed table.
    out._numbered = bool(parsed.where("gtin is not null or part is not null").limit(1).count())
    return out


def observation_items(observation: DataFrame) -> DataFrame:
    """(record_id, maker, cuvee, colour, vintage, bucket) per observation (obs_id, producer, cuvee, vintage, bucket)."""
    rows = observation.select(F.col("obs_id").cast("long").alias("record_id"), F.col("producer").alias("maker"), "cuvee", "vintage", "bucket").where("record_id is not null and producer is not null")

    def parse(record_id, maker, cuvees, year, bucket):
        out = []
        for a in cuvees:
            ws = [x for w in a or [] for x in tokens(w) if x.isalpha()]
            out.append((sorted({w for w in ws if len(w) > 1 and w not in _NO_CUVEE}), colour(ws)))
        return record_id, maker, *zip(*out), year, bucket

    year = F.when(F.col("vintage").isNull(), 0).when(F.col("vintage") < 50, F.col("vintage") + 2000).when(F.col("vintage") < 100, F.col("vintage") + 1900).otherwise(F.col("vintage"))
    plain = rows.select("record_id", "maker", "cuvee", year.cast("int").alias("vintage"), F.coalesce("bucket", F.lit("")).alias("bucket"))
    read = map_columns(plain, "record_id bigint, maker string, own array<string>, colour string, vintage int, bucket string", parse)
    return cuvee_keys(written(read, "read"))


#: What a part is where nothing is stated.
UNKNOWN = {"colour": "", "vintage": 0}


def number_classes(marked: DataFrame, guard: list[str]) -> DataFrame:
    """(number, guard..., class) of the distinct stated parts (columns ``guard``) under each number: which of them belong together.

    Parts that state most are a class each; parts that leave something open belong to
    the class they agree with if there is exactly one, else they are a class of their own.
    The rows per number are as many as there are combinations of parts, whatever the records.
    """
    stated = marked.select("number", *guard).distinct()
    other = stated.select("number", *[F.col(g).alias(f"_{g}") for g in guard])
    agree, wider = F.lit(True), F.lit(False)
    for g in guard:
        if g in UNKNOWN:
            agree = agree & ((F.col(g) == F.col(f"_{g}")) | (F.col(g) == F.lit(UNKNOWN[g])))
            wider = wider | ((F.col(g) == F.lit(UNKNOWN[g])) & (F.col(f"_{g}") != F.lit(UNKNOWN[g])))
        else:
            agree = agree & (F.col(g) == F.col(f"_{g}"))
    refined = written(stated.join(other, "number").where(agree & wider), "refined")
    open_ = refined.select("number", *guard).distinct()
    most = refined.join(open_.select("number", *[F.col(g).alias(f"_{g}") for g in guard]), ["number", *[f"_{g}" for g in guard]], "left_anti")
    own = F.xxhash64("number", *guard)
    joined = most.groupBy("number", *guard).agg(F.count("*").alias("fit"), F.min(F.xxhash64("number", *[f"_{g}" for g in guard])).alias("to"))
    return stated.join(joined, ["number", *guard], "left").select("number", *guard, F.when(F.col("fit") == 1, F.col("to")).otherwise(own).alias("class"))


def item_groups(items: DataFrame, parts: list[str]) -> DataFrame:
    """(record_id, item): equal items are those with equal ``parts``, or joined by a number without contradiction.

    Numbers are valid article numbers (gtin) and a maker's part numbers (part). Records
    without maker or cuvee stand alone unless a number joins them. Groups are
    components over item keys, so their cost does not depend on how many records share a key.
    """
    whole = (F.col("maker") != "") & (F.col("cuvee") != "")
    key = F.when(whole, F.xxhash64(*parts)).otherwise(F.xxhash64(F.lit("alone"), F.col("record_id")))
    keyed = items.withColumn("key", key)
    if "gtin" not in items.columns or not getattr(items, "_numbered", True):
        return keyed.select("record_id", F.col("key").alias("item"))
    numbers = F.explode(F.array_compact(F.array(F.concat(F.lit("g"), "gtin"), F.when(F.col("maker") != "", F.concat(F.lit("p"), "maker", F.lit("|"), "part")))))
    guard = [p for p in ("colour", "vintage", "ml", "pack") if p in parts]
    marked = written(keyed.where("gtin is not null or part is not null").select(numbers.alias("number"), "key", *guard).distinct(), "numbers")
    classes = number_classes(marked, guard)
    edges = marked.join(classes, ["number", *guard]).select(F.col("key").alias("a"), F.col("class").alias("b"))
    return keyed.join(components(edges), F.col("key") == F.col("node"), "left").select("record_id", F.coalesce("component", "key").alias("item"))


def item_pairs(groups: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of the records of each item: one equi-join, no group is gathered anywhere.

    An item of many records is cut by a salt on one side, so that its pairs, whose
    number the result fixes, are made in as many tasks as it needs.
    """
    large = written(groups.groupBy("item").count().where(F.col("count") > ITEM_ROWS).select("item", F.ceil(F.col("count") / ITEM_ROWS).cast("int").alias("cuts")), "large")
    if not rows_of(large):
        a, b = groups.withColumnRenamed("record_id", "id_a"), groups.withColumnRenamed("record_id", "id_b")
        return a.join(b, "item").where("id_a < id_b").select("id_a", "id_b")
    salted = groups.join(small_side(large), "item", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    a = salted.select("item", F.pmod(F.xxhash64("record_id"), F.col("cuts")).cast("int").alias("salt"), F.col("record_id").alias("id_a"))
    b = salted.select("item", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("salt"), F.col("record_id").alias("id_b"))
    return a.join(b, ["item", "salt"]).where("id_a < id_b").select("id_a", "id_b")


def grouped(listing: DataFrame, observation: DataFrame, book: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct (record_id, item) of the listings and of the observations."""
    a = item_groups(listing_items(listing, book), ["maker", "cuvee", "colour", "vintage", "ml", "pack"]).distinct()
    b = item_groups(observation_items(observation), ["maker", "cuvee", "colour", "vintage", "bucket"]).distinct()
    return written(a, "listing-items"), written(b, "observation-items")


def item_members(listing: DataFrame, observation: DataFrame, book: DataFrame) -> DataFrame:
    """(source, record_id, item): one row per record (more if repeated rows differ) with its item; records that stand alone have an item of their own."""
    a, b = grouped(listing, observation, book)
    return a.select(F.lit("listing").alias("source"), "record_id", "item").unionByName(b.select(F.lit("observation").alias("source"), "record_id", "item"))


def found_items(listing: DataFrame, observation: DataFrame, book: DataFrame) -> DataFrame:
    """Distinct (source, id_a, id_b) of listings, and of observations, of the same item."""
    a, b = grouped(listing, observation, book)
    return item_pairs(a).distinct().select(F.lit("listing").alias("source"), "id_a", "id_b").unionByName(item_pairs(b).distinct().select(F.lit("observation").alias("source"), "id_a", "id_b"))
