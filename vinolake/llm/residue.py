"""Template residue and error-page text: positive-unlabelled naive Bayes by expectation-maximization.

Trusted records are bodies that came with a server error (status 500 and above), a
handful of seed texts that every such corpus shares (the reason phrases of HTTP,
filler, a script notice), and texts that hold unfilled template syntax; everything
else is unlabelled. Naive Bayes over hashed words and pairs starts with the
unlabelled records as negatives and is refined by EM: trust is a prior, so real
content delivered with a wrong status is not learnt as residue, and the prior of
the unlabelled records is learnt per source. The model then scores passages
(sentences of the text without markup). A record is excluded if it holds an
unfilled placeholder, or if its passages say nothing but error, notice or filler:
one passage of real content clears it.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache
from http import HTTPStatus

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinolake.functions.glyphs import fold
from vinolake.operators.scale import spread, written

#: Hash space of words and word pairs: the model has this many weights whatever the corpus.
BUCKETS = 1 << 20
ROUNDS = 6
#: Log prior odds of a trusted error record or seed, of a record with an unfilled slot, and at first of an unlabelled one.
TRUSTED_ODDS, SLOT_ODDS, START_ODDS = 3.0, 0.0, -1.0
#: How often a seed counts.
SEED_WEIGHT = 3
#: A passage whose log odds are below this is real content and clears its record.
CLEAR = -2.0
#: Word that stands for a slot; it is no feature of the model.
SLOT = "\ue000"

# Template syntaxes in either case (not "[click here]" or an address at
# model.com); seed passages beside the reason phrases of HTTP; the crawler's own statuses.
PLACEHOLDER = re.compile(
    r"\{\{\s*[\w.$| ]+\s*\}\}|\$\{\s*[\w.]+\s*\}|#\{\s*[\w.]+\s*\}|\{\$[\w.>-]+\}|<%[=-]?\s*[\w.]+\s*%>|%%\s*[\w.]+\s*%%"
    r"|%\([\w.]+\)[sd]|\[\[\s*[\w.]+\s*\]\]|__[A-Z][A-Z0-9_.]*__|(?<![\w.])@Model\.\w[\w.]*|\[(?!(?:click|tap|press|read|see|find|look|order|buy|more|start)\b)[\w. ]+ HERE\]|&lt;insert [\w. ]+&gt;|<insert [\w. ]+>|\{%\s*\w[^%]*%\}",
    re.A | re.I,
)
#: Values that are nothing but an unfilled slot.
BARE_SLOT = re.compile(r"^\s*(\{\w*\}|%[sd]|\[object object\]|undefined|nan|null|none( none)*|tbd|todo|n/?a \?+)\s*$", re.I)
SEEDS = [
    "lorem ipsum dolor sit amet, consectetur adipiscing elit", "your text goes here", "page not found", "this site is under maintenance",
    "please enable javascript to view this page", "checking your browser before you continue", "verify that you are not a robot",
]
CRAWLER_STATUS = r"(?i)^\s*(ok|empty response|robots\.txt|blocked|circuit open|unreachable|parse error|truncated|not reached)\b(?!\s+(page|site))"
JSON = r"^\s*[\[{]\s*[\"{\[]"
# End of fixed values.

_CRAWLER = re.compile(CRAWLER_STATUS)
_SILENT = re.compile(r"<(script|style|title)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")
_BREAK = re.compile(r"</?(?:p|div|li|h\d|hr|br|td|tr|span|b|small|title|body|html|noscript|ul|head)\b[^>]*>", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[€%]")
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b")
_DIGITS = re.compile(r"\d+")
_SPACES = re.compile(r"\s+")


def seeds() -> list[str]:
    """The seed passages: reason phrases of the client and server errors of HTTP, and SEEDS."""
    return [f"{s.value} {s.phrase}" for s in HTTPStatus if s >= 400] + SEEDS


def passages(text: str) -> list[str]:
    """Sentences and blocks of the visible text, numbers masked, lower case without accents; those without letters are left out."""
    shown = text
    if "<" in text:
        shown = _TAG.sub(" ", _BREAK.sub("\n", _SILENT.sub(" ", text)))
        if not shown.strip():  # nothing but a title
            shown = _TAG.sub(" ", text)
    visible = fold(html.unescape(shown) if "&" in shown else shown).replace("’", "'")
    out = []
    for p in _SENTENCE.split(visible):
        p = _SPACES.sub(" ", _DIGITS.sub("#", _HEX.sub("#", p))).strip(" \t")
        if any(c.isalpha() or c == SLOT for c in p):
            out.append(p)
    return out


@lru_cache(maxsize=200_000)
def features(passage: str) -> tuple[int, ...]:
    """Hash buckets of the distinct words and neighbouring word pairs of a passage."""
    ws = _WORD.findall(passage)
    grams = set(ws) | {f"{a} {b}" for a, b in zip(ws, ws[1:])}
    return tuple(sorted({xxhash.xxh32_intdigest(g) % BUCKETS for g in grams}))


def parsed_records(records: DataFrame) -> DataFrame:
    """(source, record_id, trusted, slot, said) of the records (source, record_id, text, trusted) that may be residue: the passages of each, parsed once.

    Null and blank texts, JSON bodies and the crawler's own statuses never leave the JVM;
    slot tells whether the text holds an unfilled placeholder.
    """
    text = F.col("text")
    no_json = ~text.rlike(JSON) | F.ltrim(text).startswith("{{") | F.ltrim(text).startswith("[[")
    own = (F.col("source") == "coverage") & text.rlike(CRAWLER_STATUS) & ~text.rlike(r"[{}<>%\[\]@_&$#]")
    rows = records.where(F.col("record_id").isNotNull() & (F.trim(text) != "") & no_json & ~own).select("source", "record_id", F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")

    def parse(batches):
        for b in batches:
            out = []
            for source, i, trusted, text in zip(b["source"], b["record_id"], b["trusted"], b["text"]):
                filled = PLACEHOLDER.sub(f" {SLOT} ", text)
                slot = filled != text or bool(BARE_SLOT.match(text))
                if not slot and (not text.strip() or source == "coverage" and _CRAWLER.match(text)):
                    continue
                out.append((source, i, trusted, slot, passages(filled)))
            yield pd.DataFrame(out, columns=["source", "record_id", "trusted", "slot", "said"])

    return written(spread(rows).mapInPandas(parse, "source string, record_id bigint, trusted boolean, slot boolean, said array<string>"), "said")


def training_records(parsed: DataFrame) -> DataFrame:
    """(kind, n, features) of the distinct records by their passages: kind is the source of an unlabelled one, 'trusted' or 'slot'; counted over all records.

    The model learns from whole records, so that a word such as a sigh before an
    error message is learnt from what stands beside it.
    """
    kind = F.when(F.col("slot"), "slot").when(F.col("trusted"), "trusted").otherwise(F.col("source"))
    counted = parsed.where(F.size("said") > 0).groupBy("said", kind.alias("kind")).agg(F.count("*").alias("n"))
    known = parsed.sparkSession.createDataFrame([(passages(s), "trusted", SEED_WEIGHT) for s in seeds()], "said array<string>, kind string, n bigint")

    def hashed(batches):
        for b in batches:
            yield pd.DataFrame({"kind": b["kind"].astype(object), "n": b["n"], "features": [sorted({f for p in said for f in features(p)}) for said in b["said"]]})

    return written(counted.unionByName(known).mapInPandas(hashed, "kind string, n bigint, features array<int>"), "training")


@dataclass
class Model:
    """Soft counts of the buckets seen, in order, for both classes, the sizes of the classes, and the log prior odds per kind of record."""

    seen: np.ndarray
    pos: np.ndarray
    neg: np.ndarray
    sizes: tuple[float, float]
    odds: dict[str, float]

    def ratio(self, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        """Smoothed log-likelihood ratios of counts; 0 where nothing was counted."""
        r = np.log((pos + 0.1) / (self.sizes[0] + 10.0)) - np.log((neg + 0.1) / (self.sizes[1] + 10.0))
        return np.where(pos + neg > 1e-6, r, 0.0)

    def counts(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.seen):
            return np.zeros(len(buckets)), np.zeros(len(buckets))
        at = np.minimum(np.searchsorted(self.seen, buckets), len(self.seen) - 1)
        known = self.seen[at] == buckets
        return np.where(known, self.pos[at], 0.0), np.where(known, self.neg[at], 0.0)

    def score(self, buckets) -> float:
        return float(self.ratio(*self.counts(np.asarray(buckets))).sum()) if len(buckets) else 0.0


def train(table: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model, trained over all records by EM.

    Each round is one pass in which every batch adds up its soft counts per
    bucket; only the sums per bucket leave the executors, whatever the corpus.
    """
    fixed = {"trusted": TRUSTED_ODDS, "slot": SLOT_ODDS}
    kinds = sorted(r.kind for r in table.select("kind").distinct().collect())  # the sources and two more
    class_of = {k: -1 - i for i, k in enumerate(kinds)}  # the sizes of the kinds are summed as buckets of their own
    none = np.zeros(0)
    model = Model(none.astype(np.int64), none, none, (0.0, 0.0), {k: fixed.get(k, START_ODDS) for k in kinds})
    for r in range(rounds):
        state = table.sparkSession.sparkContext.broadcast(model)

        def sums(batches, state=state, r=r):
            m = state.value
            for b in batches:
                b = b[b["features"].map(len) > 0]
                if not len(b):
                    continue
                flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in b["features"]])
                size = b["features"].map(len).to_numpy()
                prior, n = b["kind"].map(m.odds).to_numpy(dtype=float), b["n"].to_numpy(dtype=float)
                pos, neg = m.counts(flat)
                if r == 1:
                    # Compared with the other records' counts: the words of a rare error are not held against it because it was first taken for content.
                    before = n / (1.0 + np.exp(-prior))
                    pos, neg = np.maximum(pos - np.repeat(before, size), 0.0), np.maximum(neg - np.repeat(n - before, size), 0.0)
                score = np.add.reduceat(m.ratio(pos, neg), np.concatenate([[0], np.cumsum(size)[:-1]])) + prior
                q = 1.0 / (1.0 + np.exp(-np.clip(score, -30, 30)))
                buckets, at = np.unique(np.concatenate([flat, b["kind"].map(class_of).to_numpy()]), return_inverse=True)
                sums = [np.bincount(at, weights=np.concatenate([np.repeat(share, size), share])) for share in (n * q, n * (1 - q))]
                yield pd.DataFrame({"bucket": buckets, "pos": sums[0], "neg": sums[1]})

        total = table.mapInPandas(sums, "bucket bigint, pos double, neg double").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toPandas().sort_values("bucket")
        state.destroy()
        classes, words = total[total["bucket"] < 0].set_index("bucket"), total[total["bucket"] >= 0]
        odds = {k: fixed.get(k, float(np.log((classes["pos"].get(x, 0.0) + 0.5) / (classes["neg"].get(x, 0.0) + 0.5)))) if r else model.odds[k] for k, x in class_of.items()}
        model = Model(words["bucket"].to_numpy(dtype=np.int64), words["pos"].to_numpy(), words["neg"].to_numpy(), (float(classes["pos"].sum()), float(classes["neg"].sum())), odds)
    return model


def judged(parsed: DataFrame, model: Model) -> DataFrame:
    """(source, record_id, by) of the records to exclude: by is 'slot' or 'model'."""
    shared = parsed.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        m = shared.value
        odds = m.odds

        @lru_cache(maxsize=100_000)
        def score(p: str) -> float:
            return m.score(features(p))

        for b in batches:
            kept = []
            for source, i, slot, said in zip(b["source"], b["record_id"], b["slot"], b["said"]):
                if slot:
                    kept.append((source, i, "slot"))
                    continue
                scores = [score(p) + odds.get(source, 0.0) for p in said]
                if any(x > 0 for x in scores) and not any(x < CLEAR for x in scores):
                    kept.append((source, i, "model"))
            yield pd.DataFrame({"source": pd.Series([k[0] for k in kept], dtype=object), "record_id": pd.Series([k[1] for k in kept], dtype="int64"), "by": pd.Series([k[2] for k in kept], dtype=object)})

    return parsed.mapInPandas(judge, "source string, record_id bigint, by string")


def residue_records(records: DataFrame) -> DataFrame:
    """Distinct (source, record_id) of the records to exclude, from records (source, record_id, text) and optionally trusted.

    trusted marks records known to be errors from elsewhere, such as a server
    error's status; null counts as false. Null, empty and blank texts, JSON bodies
    and the crawler's own statuses with or without a remark are never cases, unless
    a status holds a placeholder. Repeated records give one row. An empty table gives no rows.
    """
    if "trusted" not in records.columns:
        records = records.withColumn("trusted", F.lit(False))
    parsed = parsed_records(records)
    return judged(parsed, train(training_records(parsed))).select("source", "record_id").distinct()


def found_residue(probe_attempt: DataFrame, coverage: DataFrame) -> DataFrame:
    """Distinct (source, record_id) of probe bodies and coverage statuses that are residue."""
    a = probe_attempt.select(F.lit("probe_attempt").alias("source"), F.col("attempt_id").cast("long").alias("record_id"), F.col("body_snippet").alias("text"), (F.col("http_status") >= 500).alias("trusted"))
    b = coverage.select(F.lit("coverage").alias("source"), F.col("coverage_id").cast("long").alias("record_id"), F.col("status").alias("text"), F.lit(False).alias("trusted"))
    return residue_records(a.unionByName(b))
