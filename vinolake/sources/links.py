"""Links of pages as rows: which lead to a catalogue, in which order to try them, and which hosts they lead out to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinolake.functions.text import fold

# Words of links that lead to a catalogue, or never do; parts of addresses.
CATALOGUE_WORDS = (
    "vins vin wines wine wijnen weine boutique shop cave caves catalogue catalog produits products collection collections selection assortiment winkel promos promotions"
    " wijnkaart wijnlijst prijslijst kaart lijst carte tarif tarifs bestellen commander order"
    " alsace beaujolais bordeaux bourgogne bugey champagne corse jura languedoc loire provence rhone roussillon savoie auvergne gascogne cotes vallee"
).split()
NO_CATALOGUE_WORDS = (
    "panier cart winkelwagen compte account login connexion blog actualite actualites news journal contact cgv mentions legal livraison shipping faq about apropos"
    " newsletter checkout commande wishlist search recherche gift cadeau"
).split()
LIST_PAGES = "wijnkaart|wijnlijst|prijslijst|tarif|carte|bestellen|commander"
SLICES = "nouveaux-produits|nouveautes|promotions|promos|/content/|/s/"
NUMBERED = r"/\d+-[a-z]"
SLOTS = 10
# End of fixed values.


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)


def catalogue_link_rank(links: DataFrame, pages: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(page_id, url, place) of the links (page_id, pos, url, label) of each page (page_id, page_url) to try as catalogues, best first, at most ``slots``.

    A link counts if it stays on the host, is not the page itself, and has a catalogue
    word and no other page's word in label or path. List pages come first, then
    numbered categories, then shallow paths; slices of a catalogue share the
    slots: they get half where there are enough of both kinds, else what is left.
    """
    both = links.join(pages, "page_id").withColumn("path", path(F.col("url")))
    words = F.split(F.trim(F.regexp_replace(fold(F.concat_ws(" ", "label", "path")), "[^a-z0-9]+", " ")), " ")
    other = F.rtrim(F.col("url"), F.lit("/")) != F.rtrim(F.col("page_url"), F.lit("/"))
    has = lambda known: F.arrays_overlap(words, F.array(*[F.lit(x) for x in known]))
    kept = both.where(F.col("url").rlike("^https?://") & (host(F.col("url")) == host(F.col("page_url"))) & other & has(CATALOGUE_WORDS) & ~has(NO_CATALOGUE_WORDS))
    one = kept.groupBy("page_id", "url", "path").agg(F.min("pos").alias("pos")).withColumn("slice", F.col("path").rlike(SLICES))
    depth = F.size(F.filter(F.split("path", "/"), lambda x: x != ""))
    rank = [~F.col("path").rlike(LIST_PAGES), F.col("slice"), ~F.col("path").rlike(NUMBERED), depth, F.endswith("path", F.lit(".html")), F.col("pos")]
    within = Window.partitionBy("page_id", "slice").orderBy(*rank)
    counted = one.withColumn("r", F.row_number().over(within)).withColumn("slices", F.count_if("slice").over(Window.partitionBy("page_id"))).withColumn("whole", F.count_if(~F.col("slice")).over(Window.partitionBy("page_id")))
    # Whole catalogues get at least half of the slots and what slices leave; slices get the rest.
    first = F.least(F.col("whole"), F.greatest(F.lit(slots // 2), slots - F.col("slices")))
    chosen = counted.where(F.when(F.col("slice"), F.col("r") <= slots - first).otherwise(F.col("r") <= first))
    return chosen.select("page_id", "url", F.row_number().over(Window.partitionBy("page_id").orderBy("slice", "r")).alias("place"))


def outbound(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, host, pos) of the other hosts a page (page_id, page_url) links to, each where it is first named."""
    both = links.join(pages, "page_id").select("page_id", "pos", host(F.col("url")).alias("host"), host(F.col("page_url")).alias("own"))
    return both.where("host <> '' and host <> own").groupBy("page_id", "host").agg(F.min("pos").alias("pos"))
