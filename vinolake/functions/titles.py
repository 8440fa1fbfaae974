"""What a title says of the wine: format, tier, cuvee words, the maker's line, a label; all as Column expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vinolake.functions.text import fold, is_bundle

# Format and tier patterns in the order they are tried (on folded text), multipliers, and words that name no wine and no line.
FORMATS = [
    (375, r"half(?:\s*bottle)?|demie?(?:-?\s*bouteille)?|37[.,]?5\s*cl|375\s*ml"),
    (1500, r"magnum|mag\.?|1[.,]5\s*l|150\s*cl|1500\s*ml"),
    (3000, r"double\s*magnum|jeroboam|3[.,]0?\s*l|300\s*cl|3000\s*ml"),
    (750, r"75\s*cl|750\s*ml"),
    (620, r"clavelin|62\s*cl|620\s*ml|vin\s+jaune"),
]
FORMAT_MULTIPLIERS = {375: 0.55, 620: 0.83, 750: 1.0, 1500: 2.3, 3000: 5.0}
TIERS = [("grand_cru", r"grand\s*cru"), ("premier_cru", r"premier\s*cru|(?:^|[^0-9a-z_])1er(?:[^0-9a-z_]|$)"), ("bourgogne", r"(?:^|[^0-9a-z_])bourgogne(?:[^0-9a-z_]|$)")]
VILLAGES = [
    "chambolle-musigny", "chambolle musigny", "gevrey-chambertin", "gevrey chambertin", "vosne-romanee", "vosne romanee", "nuits-saint-georges", "nuits saint georges",
    "chassagne-montrachet", "chassagne montrachet", "puligny-montrachet", "puligny montrachet", "morey-saint-denis", "morey saint denis", "volnay", "pommard", "meursault", "beaune",
    "marsannay", "fixin", "santenay", "auxey-duresses", "auxey duresses",
]
NO_CUVEE_WORDS = (
    "de du des la le les l d et a au aux en the of and van der den il el vin vins wine wijn weine bouteille bottle fles cuvee domaine dom chateau maison clos"
    " magnum jeroboam demie demi half cl ml coffret caisse carton case box assortiment bio nature naturel natural organic new nouveau arrivage stock vente sale promo"
).split()
NO_LINE_WORDS = (
    "domaine dom chateau ch maison clos vignoble vignobles earl scea gaec les le la du de des vins vin cave caves famille"
    " blanc blanche rouge rose jaune brut sec doux white red orange petillant cremant"
).split()
LINE_WORDS = 4
# End of fixed values.


def bounded(pattern: str) -> str:
    """The pattern where it is no part of a longer word; the same in Java's and DuckDB's regular expressions."""
    return rf"(?:^|[^0-9a-z_])(?:{pattern})(?:[^0-9a-z_]|$)"


def stated_format(text: Column) -> Column:
    """Bottle size in ml of the first format that matches, null if none does."""
    folded, out = fold(text), F.lit(None).cast("int")
    for ml, pattern in reversed(FORMATS):
        out = F.when(folded.rlike(bounded(pattern)), ml).otherwise(out)
    return out


def bucket(text: Column) -> Column:
    """coffret for several bottles sold together, else bottle."""
    return F.when(is_bundle(text), "coffret").otherwise("bottle")


def to_750(price: Column, ml: Column) -> Column:
    """A price brought to 75 cl by its format's multiplier; an unknown format counts as 75 cl."""
    factor = F.lit(1.0)
    for size, m in FORMAT_MULTIPLIERS.items():
        factor = F.when(ml == size, m).otherwise(factor)
    return F.try_divide(price, factor)


def tier(text: Column) -> Column:
    """The tier of a title, highest first; null if it names none."""
    folded = fold(text)
    out = F.when(folded.rlike("|".join(VILLAGES)), "village")
    for name, pattern in reversed(TIERS):
        out = F.when(folded.rlike(pattern), name).otherwise(out)
    return out


def without_phrases(folded: Column, phrases: Column) -> Column:
    """A folded text with every phrase replaced by a space wherever it stands, longest first, equal lengths in order."""
    sized = F.array_sort(F.transform(F.array_distinct(F.filter(phrases, lambda p: F.length(p) > 0)), lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))
    return F.aggregate(sized, folded, lambda text, x: F.replace(text, x["p"], F.lit(" ")))


def name_words(name: Column) -> Column:
    return F.filter(F.split(F.replace(F.coalesce(name, F.lit("")), F.lit("/"), F.lit(" ")), r"\s+"), lambda w: F.length(w) > 0)


def cuvee_words_of(folded: Column, phrases: Column) -> Column:
    """``cuvee_words`` of a folded title and folded phrases."""
    words = F.regexp_extract_all(without_phrases(folded, phrases), F.lit("[a-z]{2,}"), F.lit(0))
    return F.array_sort(F.array_except(words, F.array(*[F.lit(w) for w in NO_CUVEE_WORDS])))


def cuvee_words(title: Column, producer: Column, aliases: Column, line: Column) -> Column:
    """The sorted words of a title that are left without the maker's names and its line, and without words that name no wine."""
    return cuvee_words_of(fold(title), F.transform(F.concat(aliases, name_words(producer), name_words(line)), lambda p: fold(p)))


def maker_line_of(folded: Column, names: Column, producer: Column) -> Column:
    """``maker_line`` of a folded title, the folded names to look for and the folded name of the maker."""
    first = F.array_min(F.filter(F.transform(names, lambda a, i: F.struct(F.position(a, folded).alias("at"), i.alias("i"), a.alias("a"))), lambda x: x["at"] > 0))
    tail = F.regexp_extract(F.substring(folded, F.lit(1), first["at"] - 1), r"([a-z\s'’-]*)$", 1)
    before = F.regexp_extract_all(tail, F.lit("[a-z]{2,}"), F.lit(0))
    last = F.slice(before, F.greatest(F.size(before) - LINE_WORDS + 1, F.lit(1)), LINE_WORDS)
    words = F.concat(last, F.regexp_extract_all(first["a"], F.lit("[a-z]{2,}"), F.lit(0)))
    kept = F.array_join(F.filter(words, lambda w: ~w.isin(NO_LINE_WORDS)), " ")
    return F.when(first.isNotNull() & (kept != ""), kept).otherwise(producer)


def names_of(producer: Column, aliases: Column) -> Column:
    """The folded names a maker is looked for by: its aliases, else its own name."""
    return F.filter(F.transform(F.when(F.size(aliases) > 0, aliases).otherwise(F.array(producer)), lambda a: fold(a)), lambda a: F.length(a) > 0)


def maker_line(title: Column, producer: Column, aliases: Column) -> Column:
    """Which line of a maker a title belongs to: the words of the name phrase that ends in the maker's first-standing alias, generic ones left out; the folded name if none stand."""
    return maker_line_of(fold(title), names_of(producer, aliases), fold(producer))


def label(title: Column, producer: Column) -> Column:
    """A title without the maker's words, for display; the title itself if nothing is left."""
    title = F.coalesce(title, F.lit(""))
    bare = F.aggregate(name_words(producer), title, lambda text, w: F.regexp_replace(text, F.concat(F.lit("(?iu)\\Q"), w, F.lit("\\E")), F.lit("")))
    out = F.trim(F.regexp_replace(bare, r"\s{2,}", " "), F.lit(" -,"))
    return F.when(out == "", title).otherwise(out)


def override(title: Column, cuvees: Column) -> Column:
    """The first entry of a price book's nested cuvees of which a match phrase stands in the title; null if none does."""
    folded = fold(title)
    return F.try_element_at(F.filter(cuvees, lambda c: F.exists(c["match"], lambda m: F.contains(folded, fold(m)))), F.lit(1))
