"""Subject areas of documents: interpolated bigram models per subject and language, compared with background models.

A subject's model is P(w2 | w1) interpolated with its P(w2), that with the
background's P(w2), and that with the uniform distribution (Witten-Bell weights
throughout); the background model of a subject is built alike from the documents
that do not have it. The unit is the sentence: its score is the cross-entropy
per token under the background less that under the subject. A document has
every subject to which it devotes at least two accepted sentences.

Labels do not say which sentences are meant, so sentences of labelled documents
are shared out between their document's subjects and the background by
expectation-maximization, over all labelled documents. Counts are taken on the
executors; sums per word, pair and subject are all that reaches the driver, so
what it holds grows with the vocabulary and not with the documents. Acceptance
thresholds are calibrated per subject on labelled documents held out from the counts.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinolake.functions.glyphs import fold
from vinolake.operators.scale import fits, map_columns, running, small_side, spread, written

#: Documents that a worker handles at once, and counts of pairs it sends on at once.
PART, MANY_PAIRS = 512, 200_000
#: Fewest occurrences (within the labelled documents) of a word, else it is read as the unknown word; and of a pair.
MIN_WORD, MIN_PAIR = 3, 2
ROUNDS = 6
#: Every such document is held out from the counts when thresholds are calibrated.
HELD_OUT = 5
#: Weight of the sentences next to a sentence, and the bound on what a token of theirs can add.
CONTEXT, CLIP = 0.4, 1.0
#: A sentence whose own gain is below minus this is not made one of a passage by its neighbours.
SILENT = 0.1
#: Log prior odds of the background against a subject for a sentence of a labelled document, while fitting.
MARGIN = 3.0
#: A passage is this many sentences at least.
PASSAGE = 2
#: Threshold drawn to where a subject's held-out labels are few, and the labels it counts as.
DEFAULT_CUT, DEFAULT_WEIGHT = 0.1, 30.0

#: Buckets per nat in which held-out scores are ranked.
BUCKETS = 1_000

_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»)]*\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, lower case without accents, numbers left out."""
    out = []
    for s in _SENTENCE.split(fold(text).replace("ß", "ss").replace("œ", "oe")):
        ws = _WORD.findall(s)
        if len(ws) >= 2:
            out.append(ws)
    return out


@dataclass
class Lexicon:
    """Ids of the words and pairs of every language; each language has one unknown word and one sentence start.

    Contexts are numbered as the words, then the sentence starts of the languages in order.
    """

    langs: list[str]
    words: dict[str, dict[str, int]]
    unknown: dict[str, int]
    #: context x size + word of the known pairs, in order; a pair's id is its place.
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    @classmethod
    def of(cls, rows: list[tuple[str, str]]) -> "Lexicon":
        langs = sorted({lang for lang, _ in rows})
        words: dict[str, dict[str, int]] = {lang: {} for lang in langs}
        unknown = {lang: k for k, lang in enumerate(langs)}
        for n, (lang, w) in enumerate(sorted(rows)):
            words[lang][w] = len(langs) + n
        return cls(langs, words, unknown)

    @property
    def size(self) -> int:
        return len(self.langs) + sum(map(len, self.words.values()))

    def languages(self) -> np.ndarray:
        """The number of the language of each word."""
        out = np.zeros(self.size, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            out[self.unknown[lang]] = k
            out[list(self.words[lang].values())] = k
        return out

    def ids(self, words, lang: str) -> list[int]:
        get, unk = self.words[lang].get, self.unknown[lang]
        return [get(w, unk) for w in words]

    def guess(self, lang: str | None, sents: list[list[str]]) -> str | None:
        """The stated language if there is a model for it, else the one that knows most of the words."""
        if lang in self.words:
            return lang
        said = {w for ws in sents for w in ws}
        known = {k: len(said & m.keys()) for k, m in self.words.items()}
        return max(known, key=lambda k: (known[k], k)) if known and max(known.values()) else None


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` over consecutive stretches of the given lengths."""
    out = np.zeros((len(lengths), values.shape[1]), dtype=np.float64)
    full = np.nonzero(lengths)[0]
    if len(full):
        out[full] = np.add.reduceat(values, np.concatenate([[0], np.cumsum(lengths[full])[:-1]]), axis=0)
    return out


class Encoded:
    """Sentences as arrays: tokens and known pairs, flat, with their number per sentence, and the context each sentence starts in."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self._tokens, self._n, self._start = lexicon, array("i"), array("i"), array("i")

    def add(self, sents: list[list[str]], lang: str) -> None:
        get, unk = self.lexicon.words[lang].get, self.lexicon.unknown[lang]
        for ws in sents:
            self._tokens.extend([get(w, unk) for w in ws])
            self._n.append(len(ws))
        self._start.extend([self.lexicon.size + unk] * len(sents))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, tokens per sentence, pairs, pairs per sentence, context of each sentence's first word)."""
        tokens, n, start = (np.array(x, dtype=np.int64) for x in (self._tokens, self._n, self._start))
        codes = self.lexicon.pairs
        if not len(tokens) or not len(codes):
            return tokens, n, np.zeros(0, dtype=np.int64), np.zeros(len(n), dtype=np.int64), start
        before = np.concatenate([[0], tokens[:-1]])
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        before[first] = start
        code = before * self.lexicon.size + tokens
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        known = codes[at] == code
        return tokens, n, at[known], np.add.reduceat(known.astype(np.int64), first), start


@dataclass
class Ratios:
    """Log-probability ratios subject / background: of words by P(w), of what contexts leave to P(w), and of seen pairs on top."""

    word: np.ndarray
    context: np.ndarray
    pair: np.ndarray

    def only(self, s: int) -> "Ratios":
        """Those of one subject."""
        return Ratios(*(x[:, s : s + 1] for x in (self.word, self.context, self.pair)))

    def of_sentences(self, tokens, n, pairs, m, start: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each sentence for each subject; ``start`` is the context of each sentence's first word."""
        if not len(n):
            return np.zeros((0, self.word.shape[1]))
        last = tokens[np.cumsum(n) - 1]
        inside = self.word + self.context[: len(self.word)]
        return _sums(inside[tokens], n) - self.context[last] + self.context[start] + _sums(self.pair[pairs], m)


class Counts:
    """(Soft) counts per subject of words, of words that end a sentence, of pairs, and of sentences per language."""

    def __init__(self, matrix: np.ndarray, lexicon: Lexicon):
        w, p = lexicon.size, len(lexicon.pairs)
        self._of = matrix, lexicon
        self.word, self.last, self.pair, self.start = matrix[:w], matrix[w : 2 * w], matrix[2 * w : 2 * w + p], matrix[2 * w + p :]

    def only(self, s: int) -> "Counts":
        """Those of one subject."""
        matrix, lexicon = self._of
        return Counts(matrix[:, s : s + 1], lexicon)

    @staticmethod
    def rows(lexicon: Lexicon) -> int:
        return 2 * lexicon.size + len(lexicon.pairs) + len(lexicon.langs)


def log_ratios(own: Counts, outside: Counts, lexicon: Lexicon) -> Ratios:
    """Log-ratios of a subject's interpolated model to that of its background.

    P(w2|w1) = (c(w1 w2) + t(w1) P(w2)) / (c(w1) + t(w1)), t(w1) being one more than the
    number of different words after w1: a pair that was never seen costs the
    context's t / (c + t) times P(w2), whatever the pair, so sentences are scored by sums.
    """
    lang = lexicon.languages()
    first, second = lexicon.pairs // lexicon.size, lexicon.pairs % lexicon.size

    def per_language(x):
        out = np.zeros((len(lexicon.langs), x.shape[1]))
        np.add.at(out, lang, x)
        return out

    def unigram(c: Counts, below: np.ndarray) -> np.ndarray:
        n, kinds = per_language(c.word), np.maximum(per_language(np.minimum(c.word, 1.0)), 1.0)
        return (c.word + kinds[lang] * below) / (n + kinds)[lang]

    def bigram(c: Counts, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        follow = np.ones((lexicon.size + len(lexicon.langs), p.shape[1]))
        np.add.at(follow, first, np.minimum(c.pair, 1.0))
        n = np.concatenate([c.word - c.last, c.start])
        rest = follow[first] * p[second]
        return np.log(follow / (n + follow)), np.log((c.pair + rest) / rest)

    uniform = (1.0 / np.maximum(np.bincount(lang, minlength=len(lexicon.langs)), 1))[lang][:, None]
    subjects = own.word.shape[1]
    out = Ratios(*(np.empty((k, subjects), dtype=np.float32) for k in (lexicon.size, lexicon.size + len(lexicon.langs), len(lexicon.pairs))))
    for s in range(subjects):  # one by one: the arrays in between are larger than the result
        behind = unigram(outside.only(s), uniform)
        mine = unigram(own.only(s), behind)
        (a, b), (a0, b0) = bigram(own.only(s), mine), bigram(outside.only(s), behind)
        out.word[:, s], out.context[:, s], out.pair[:, s] = np.log(mine / behind)[:, 0], (a - a0)[:, 0], (b - b0)[:, 0]
    return out


class SubjectModel:
    """The lexicon, the subjects' log-ratios, and the acceptance threshold of each subject (nats per token)."""

    def __init__(self, names: list[str], lexicon: Lexicon, ratios: Ratios | None, thresholds: dict[str, float]):
        self.names, self.lexicon, self.ratios, self.thresholds = names, lexicon, ratios, thresholds

    def best_sentences(self, docs: list[tuple[list[list[str]], str | None]]) -> list[dict[str, list[float]]]:
        """Per document (sentences, language) and subject the scores of the sentences of which it is the best subject, largest first.

        A score is the gain in cross-entropy per token; a sentence's takes in part of its neighbours' in the same document.
        """
        out: list[dict[str, list[float]]] = [defaultdict(list) for _ in docs]
        enc, doc = Encoded(self.lexicon), array("i")
        for d, (sents, lang) in enumerate(docs):
            chosen = self.lexicon.guess(lang, sents)
            if chosen is None:
                continue
            enc.add(sents, chosen)
            doc.extend([d] * len(sents))
        if not len(doc) or not self.names:
            return out
        tokens, n, pairs, m, start = enc.arrays()
        doc = np.frombuffer(doc, dtype=np.int32)
        own = self.ratios.of_sentences(tokens, n, pairs, m, start)
        size = n[:, None].astype(np.float64)
        near = np.clip(own, -CLIP * size, CLIP * size)
        same = (doc[1:] == doc[:-1])[:, None]
        total, length = own.copy(), size.copy()
        for a, b in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
            total[a] += CONTEXT * near[b] * same
            length[a] += CONTEXT * size[b] * same
        gain = total / length
        top = gain.argmax(1)
        best = gain[np.arange(len(doc)), top]
        # a sentence that says nothing itself is not made one by its neighbours
        ok = (best > 0) & (own[np.arange(len(doc)), top] > -SILENT * n)
        for k in np.nonzero(ok)[0]:
            out[doc[k]][self.names[top[k]]].append(float(best[k]))
        return [{s: sorted(v, reverse=True) for s, v in d.items()} for d in out]

    def subjects(self, docs: list[tuple[list[list[str]], str | None]]) -> list[list[str]]:
        """The subjects of each document (sentences, language)."""
        return [sorted(s for s, v in best.items() if len(v) >= PASSAGE and v[PASSAGE - 1] >= self.thresholds.get(s, DEFAULT_CUT)) for best in self.best_sentences(docs)]


def _parts(batches):
    """The frames in pieces of at most PART rows, so that what a worker holds does not grow with the batches."""
    for b in batches:
        for at in range(0, len(b), PART):
            yield b.iloc[at : at + PART]


def _soft_counts(table: DataFrame, lexicon: Lexicon, subjects: int, models: list[tuple[int, Ratios | None]], outside: bool) -> list[np.ndarray]:
    """One pass over the encoded documents: counts per row of ``Counts`` and subject, for each of the models.

    A model is (fold it must not see or -1, its ratios or None at the start). With
    ``outside`` every sentence counts for the subjects its document does not have,
    else as far as the model gives it to a subject the document has.
    """
    rows, w, p = Counts.rows(lexicon), lexicon.size, len(lexicon.pairs)
    shared = table.sparkSession.sparkContext.broadcast(models)
    # those outside a subject are all less those that have it
    width = subjects + outside
    columns = [f"c{k}" for k in range(len(models) * width)]

    def run(batches):
        total = np.zeros((len(columns), rows))
        for b in _parts(batches):
            tokens, n, pairs, m = (np.concatenate([np.asarray(x, dtype=np.int64) for x in b[c]]) for c in ("tokens", "n", "pairs", "m"))
            count = b["n"].map(len).to_numpy()
            start = np.repeat(b["lang"].to_numpy(), count)
            fold_of = np.repeat(b["fold"].to_numpy(), count)
            counts = (np.repeat(b["mask"].to_numpy(), count)[:, None] >> np.arange(subjects)) & 1 > 0
            if outside:
                counts = np.hstack([counts, np.ones((len(counts), 1), dtype=bool)])
            # of each subject only the sentences that can count for it
            own = [(tokens[np.repeat(c, n)], n[c], pairs[np.repeat(c, m)], m[c], w + start[c]) for c in counts.T]
            for at, (unseen, ratios) in enumerate(shared.value):
                if outside:
                    share = counts.astype(float)
                elif ratios is None:
                    share = counts * (0.5 / np.maximum(counts.sum(1, keepdims=True), 1))
                else:
                    score = np.full(counts.shape, -np.inf)
                    for s in range(subjects):
                        score[counts[:, s], s] = ratios.only(s).of_sentences(*own[s])[:, 0] - MARGIN
                    top = np.maximum(score.max(1, keepdims=True), 0.0)
                    e = np.exp(score - top)
                    share = e / (np.exp(-top) + e.sum(1, keepdims=True))
                share = share * (fold_of != unseen)[:, None]
                for s, (t, k, q, j, first) in enumerate(own):
                    c, v = total[at * width + s], share[counts[:, s], s]
                    if not v.any():
                        continue
                    np.add.at(c, t, np.repeat(v, k))
                    np.add.at(c, w + t[np.cumsum(k) - 1], v)
                    np.add.at(c, 2 * w + q, np.repeat(v, j))
                    np.add.at(c, w + p + first, v)
        some = np.nonzero(total.any(0))[0]
        for a in range(0, len(some), MANY_PAIRS):
            at = some[a : a + MANY_PAIRS]
            yield pd.DataFrame({"id": at, **{c: total[k, at] for k, c in enumerate(columns)}})

    sums = table.mapInPandas(run, "id bigint, " + ", ".join(f"{c} double" for c in columns)).groupBy("id").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    matrix = np.zeros((len(columns), rows))
    at = sums["id"].to_numpy()
    for k, c in enumerate(columns):  # without a frame of all columns in between
        matrix[k, at] = sums[c].to_numpy()
    parts = [matrix[k * width : (k + 1) * width] for k in range(len(models))]
    return [(x[-1:] - x[:-1]).T if outside else x.T for x in parts]


def _cut(points: list[tuple[float, bool]]) -> float:
    """The threshold with the best F1 over (score, is true); half way to the next score below."""
    want = sum(b for _, b in points) or 1
    points = sorted((p for p in points if p[0] > -math.inf), reverse=True)
    best, cut, tp = -1.0, DEFAULT_CUT, 0
    for k, (v, b) in enumerate(points):
        tp += b
        f1 = 2 * tp / (k + 1 + want)
        if f1 > best + 1e-9 and (k + 1 == len(points) or points[k + 1][0] < v):
            below = points[k + 1][0] if k + 1 < len(points) else 0.0
            best, cut = f1, (v + max(below, 0.0)) / 2
    return cut


def _cuts(points: DataFrame) -> dict[int, tuple[int, float]]:
    """Per subject, and over all subjects as -1, the number of true points (subject, score, is) and their ``_cut``.

    Points that do not fit here are ranked in buckets of the score, and one row per subject reaches the driver.
    """
    if fits(points):
        own: dict[int, list[tuple[float, bool]]] = defaultdict(list)
        for s, v, b in points.toPandas().itertuples(index=False):
            for k in (s, -1):
                own[k].append((-math.inf if math.isnan(v) else v, b))
        return {k: (sum(b for _, b in v), _cut(v)) for k, v in own.items()}
    every = points.withColumn("subject", F.explode(F.array("subject", F.lit(-1))))
    ranked = written(every.groupBy("subject", "score").agg(F.count("*").alias("n"), F.count_if("is").alias("t")), "scores")
    want = {r.subject: r.want for r in ranked.groupBy("subject").agg(F.sum("t").alias("want")).collect()}  # a row per subject, as below
    if not want:
        return {}
    all_true = F.create_map(*[F.lit(x) for k, n in want.items() for x in (k, max(n, 1))])
    # both sums in one number: of all points above, and of the true ones
    both = F.shiftleft(F.col("n"), 32) + F.col("t")
    above = running(ranked.where("score is not null"), ["subject"], [F.desc("score")], both, "above", bucket=F.floor(F.col("score") * -BUCKETS))
    upto = F.col("above") + both
    f1 = 2 * upto.bitwiseAND(F.lit((1 << 32) - 1)) / (F.shiftright(upto, 32) + all_true[F.col("subject")])
    best = {r.subject: r.best.score for r in above.groupBy("subject").agg(F.max(F.struct(f1.alias("f1"), "score")).alias("best")).collect()}
    below = {}
    if best:
        cut = F.create_map(*[F.lit(x) for kv in best.items() for x in kv])
        below = {r.subject: r.below for r in ranked.where(F.col("score") < cut[F.col("subject")]).groupBy("subject").agg(F.max("score").alias("below")).collect()}
    return {k: (n, (best[k] + max(below.get(k, 0.0), 0.0)) / 2 if k in best else DEFAULT_CUT) for k, n in want.items()}


def calibrate(points: DataFrame, names: list[str]) -> dict[str, float]:
    """Per subject the threshold on the second-best sentence with the best F1 over held-out documents, drawn to the pooled one (and that to DEFAULT_CUT) where labels are few.

    ``points`` are (subject as a place in ``names``, score or null, whether it is true).
    """
    cuts = _cuts(points)
    many, pooled = cuts.get(-1, (0, DEFAULT_CUT))
    pooled = (many * pooled + 2 * DEFAULT_WEIGHT * DEFAULT_CUT) / (many + 2 * DEFAULT_WEIGHT)
    out = {}
    for k, s in enumerate(names):
        n, cut = cuts.get(k, (0, DEFAULT_CUT))
        out[s] = (n * cut + DEFAULT_WEIGHT * pooled) / (n + DEFAULT_WEIGHT)
    return out


def train(labelled: DataFrame) -> SubjectModel:
    """The model from labelled documents (doc_id, text, lang, subjects), however many (``labelled_documents``).

    Two models are fitted at once: one from the documents that are not held out,
    which only serves to calibrate the thresholds, and one from all.
    """
    spark = labelled.sparkSession
    names = sorted(r.s for r in labelled.select(F.explode("subjects").alias("s")).distinct().collect())  # the subject areas, a fixed list
    if not names:
        return SubjectModel([], Lexicon([], {}, {}), None, {})
    bit = {s: k for k, s in enumerate(names)}

    def split(batches):
        for b in _parts(batches):
            rows = [(int(h), lang, sum(1 << bit[s] for s in ss), ws) for h, lang, ss, text in zip(b["h"], b["lang"], b["subjects"], b["text"]) if text and lang for ws in [sentences(text)] if ws]
            yield pd.DataFrame(rows, columns=["fold", "lang", "mask", "sents"])

    hashed = labelled.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)).cast("int"))
    docs = written(spread(hashed).mapInPandas(split, "fold int, lang string, mask bigint, sents array<array<string>>"), "labelled")
    # The words and pairs said often enough go to the driver and the workers: they grow with the vocabulary, not with the documents.
    counted = docs.select("lang", F.explode(F.flatten("sents")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_WORD)
    lexicon = Lexicon.of([(r.lang, r.word) for r in counted.select("lang", "word").collect()])
    if not lexicon.langs:
        return SubjectModel([], lexicon, None, {})
    shared = spark.sparkContext.broadcast(lexicon)

    def pairs(batches):
        lex = shared.value
        seen: dict[int, int] = defaultdict(int)

        def counted_so_far():
            out = pd.DataFrame({"code": pd.Series(list(seen), dtype="int64"), "n": pd.Series(list(seen.values()), dtype="int64")})
            seen.clear()
            return out

        for b in _parts(batches):
            for lang, sents in zip(b["lang"], b["sents"]):
                if lang in lex.words:
                    for ws in sents:
                        ids = lex.ids(list(ws), lang)
                        for a, z in zip([lex.size + lex.unknown[lang], *ids], ids):
                            seen[a * lex.size + z] += 1
            if len(seen) > MANY_PAIRS:
                yield counted_so_far()
        yield counted_so_far()

    kept = docs.select("lang", "sents").mapInPandas(pairs, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_PAIR).toPandas()
    lexicon.pairs = np.sort(kept["code"].to_numpy(dtype=np.int64))
    complete = spark.sparkContext.broadcast(lexicon)

    def encode(batches):
        lex = complete.value
        for b in _parts(batches):
            rows = []
            for h, lang, mask, sents in zip(b["fold"], b["lang"], b["mask"], b["sents"]):
                if lang in lex.words:
                    enc = Encoded(lex)
                    enc.add(sents, lang)
                    rows.append((h, lex.unknown[lang], mask, *(a.tolist() for a in enc.arrays()[:4])))
            yield pd.DataFrame(rows, columns=["fold", "lang", "mask", "tokens", "n", "pairs", "m"])

    encoded = written(docs.mapInPandas(encode, "fold int, lang int, mask bigint, tokens array<int>, n array<int>, pairs array<int>, m array<int>"), "encoded")
    folds = [0, -1]
    outside = [Counts(x, lexicon) for x in _soft_counts(encoded, lexicon, len(names), [(k, None) for k in folds], True)]
    ratios: list[Ratios | None] = [None for _ in folds]
    for _ in range(ROUNDS):
        own = _soft_counts(encoded, lexicon, len(names), list(zip(folds, ratios)), False)
        ratios = [log_ratios(Counts(x, lexicon), o, lexicon) for x, o in zip(own, outside)]
    judge = spark.sparkContext.broadcast(SubjectModel(names, lexicon, ratios[0], {}))

    def held(batches):
        model = judge.value
        for b in _parts(batches):
            docs = [([list(ws) for ws in sents], lang) for sents, lang in zip(b["sents"], b["lang"])]
            rows = [(k, v[s][PASSAGE - 1] if len(v.get(s, [])) >= PASSAGE else None, bool(mask >> k & 1)) for v, mask in zip(model.best_sentences(docs), b["mask"]) for k, s in enumerate(names)]
            rows = [r for r in rows if r[1] is not None or r[2]]  # the others change no F1
            yield pd.DataFrame({"subject": pd.Series([r[0] for r in rows], dtype="int32"), "score": pd.Series([r[1] for r in rows], dtype="float64"), "is": pd.Series([r[2] for r in rows], dtype=bool)})

    points = written(docs.where("fold = 0").mapInPandas(held, "subject int, score double, is boolean"), "points")
    return SubjectModel(names, lexicon, ratios[1], calibrate(points, names))


def with_subjects(documents: DataFrame, model: SubjectModel) -> DataFrame:
    """(doc_id, subject), one row per subject of each document (doc_id, text, lang); whole texts, one narrow pass.

    Null and empty texts and documents without a passage on any subject give no
    row; a repeated document gives repeated rows. The model grows with the
    vocabulary of the labelled documents and goes out once as a broadcast variable.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(doc_id, texts, langs):
        m = shared.value
        ids, found = [], []
        for at in range(0, len(doc_id), 1024):
            part = slice(at, at + 1024)
            docs = [(sentences(text) if text else [], lang) for text, lang in zip(texts[part], langs[part])]
            for i, ss in zip(doc_id[part], m.subjects(docs)):
                ids += [i] * len(ss)
                found += ss
        return ids, found

    return map_columns(spread(documents.select("doc_id", "text", "lang")), "doc_id bigint, subject string", run)


def labelled_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, subjects) of all labelled documents."""
    own = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    return documents.select("doc_id", "text", "lang").join(small_side(own), "doc_id")


def found_subjects(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct (doc_id, subject) of every document's subject areas."""
    docs = documents.select(F.col("doc_id").cast("long"), "text", "lang").where("doc_id is not null and text is not null")
    return with_subjects(docs, train(labelled_documents(docs, labels))).distinct()
