"""Character forms: which characters are only another shape of the usual one.

Everything here is derived from the Unicode character database at import, apart
from the look-alike letters, which no standard-library table holds.

Used by Python workers (``repair``, ``skeleton``) behind a JVM filter (``SUSPECT``).
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

# Letters of other scripts that look like a Latin letter, per script, and what they look like.
_TWINS = {
    "cyrillic": ("АВЕКМНОРСТУХЅІЈԌҮҺԚԜаеорсухѕіјһԁԛԝѵ", "ABEKMHOPCTYXSIJGYhQWaeopcyxsijhdqwv"),
    "greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορικχ", "ABEZHIKMNOPTYXavopikx"),
    "armenian": ("օհոսցՕ", "ohnugO"),
    "phonetic": ("ɑɡ", "ag"),
}
_RANGES = {"latin": "A-Za-zªºÀ-ɏḀ-ỿ", "greek": "Ͱ-Ͽ", "cyrillic": "Ѐ-ԯ", "armenian": "԰-֏", "phonetic": "ɐ-ʯ"}
# End of fixed values.

LOOKALIKE = {a: b for theirs, ours in _TWINS.values() for a, b in zip(theirs, ours)}
#: Per script the letter that stands for a Latin one.
_BACK = {s: {b: a for a, b in zip(theirs, ours)} for s, (theirs, ours) in _TWINS.items()}

_STYLED_KINDS = ("<font>", "<wide>", "<narrow>", "<circle>")


def _styled() -> dict[int, str]:
    """Characters whose compatibility form is the same letter, digit or sign in plain style."""
    out = {}
    for cp in range(0x80, min(sys.maxunicode, 0x1FFFF) + 1):
        ch = chr(cp)
        kind = unicodedata.decomposition(ch).split(" ")[0]
        if kind in _STYLED_KINDS or (kind == "<compat>" and unicodedata.category(ch)[0] == "L"):
            plain_form = unicodedata.normalize("NFKC", ch)
            if plain_form != ch and not any(c.isspace() for c in plain_form):
                out[cp] = plain_form
    return out


STYLED = _styled()
SPACES = {cp: " " for cp in range(0x80, 0x3001) if unicodedata.category(chr(cp)) == "Zs"}
INVISIBLE = {
    cp: None
    for cp in [*range(0x80, 0x2100), 0xFEFF, *range(0xE0000, 0xE0080)]
    if unicodedata.category(chr(cp)) == "Cf" and cp not in range(0x600, 0x620)
}
_TABLE = {**STYLED, **SPACES, **INVISIBLE}
_FOREIGN = re.compile("[" + "".join(r for s, r in _RANGES.items() if s != "latin") + "]")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN_MARKS = re.compile("[\u0300-\u036f]+")
_RARE_RANGE = re.compile("[\u0483-\u1fff\u20d0-\U0001ffff]")
_MARKS = re.compile("[" + "".join(chr(c) for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))) + "]+")
_SCRIPTS = {s: re.compile(f"[{r}]") for s, r in _RANGES.items()}


def _usual() -> str:
    """A class of what is surely in the usual form: ASCII, accented Latin, dashes, quotes and currency signs that no table above changes.

    It lists a few ranges, because a class of the hundreds of variants costs the JVM forty times as much.
    """
    out = "\\x00-\\x7E"
    for first, last in ((0xA1, 0x24F), (0x2010, 0x2027), (0x20A0, 0x20BF)):
        run: list[int] = []
        for cp in range(first, last + 2):
            if cp <= last and cp not in _TABLE:
                run.append(cp)
            elif run:
                out += f"\\u{run[0]:04X}-\\u{run[-1]:04X}"
                run = []
    return out


#: Pattern of Java and Python: a value without a match is surely in the usual form.
SUSPECT = f"[^{_usual()}]"
_ODD = re.compile(SUSPECT)


def to_latin(word: str) -> str | None:
    """The word with every look-alike replaced, or None if a letter has no Latin twin."""
    out = []
    for ch in word:
        if ch in LOOKALIKE:
            out.append(LOOKALIKE[ch])
        elif _FOREIGN.match(ch):
            base = unicodedata.normalize("NFD", ch)
            if base[0] not in LOOKALIKE or len(base) > 2:
                return None
            out.append(unicodedata.normalize("NFC", LOOKALIKE[base[0]] + base[1:]))
        else:
            out.append(ch)
    return "".join(out)


def composed(text: str) -> str:
    """Plain spaces, no invisible characters, plain style, one character per accented letter."""
    if text.isascii() or not _ODD.search(text):
        return text
    return unicodedata.normalize("NFC", text.translate(_TABLE))


def dominant_script(word: str) -> str:
    """The script most letters of a token are of; a letter that no other script imitates counts three times."""
    weight = dict.fromkeys(_RANGES, 0)
    for ch in word:
        for s, letters in _SCRIPTS.items():
            if letters.match(ch):
                base = unicodedata.normalize("NFD", ch)[0]
                imitated = base in LOOKALIKE if s != "latin" else any(base in back for back in _BACK.values())
                weight[s] += 1 if imitated else 3
    return max(weight, key=lambda s: (weight[s], s == "latin"))


def to_script(word: str, script: str) -> str | None:
    """The word with every Latin letter replaced by the look-alike of another script, or None if one has none."""
    out = [_BACK[script].get(ch, None if _SCRIPTS["latin"].match(ch) else ch) for ch in word]
    return None if None in out else "".join(out)


@lru_cache(maxsize=100_000)
def readings(word: str) -> tuple[str, ...]:
    """The forms a token with foreign letters may stand for, that in its dominant script first; itself is none of them."""
    if not _FOREIGN.search(word):
        return ()
    script, latin = dominant_script(word), to_latin(word)
    own = to_script(word, script) if script != "latin" and _SCRIPTS["latin"].search(word) else None
    return tuple(r for r in (own, latin) if r is not None and r != word)


def repair(text: str, known=frozenset()) -> tuple[str, list[str]]:
    """The repaired text, and the readings (lower case) of tokens with foreign letters that were not in ``known``.

    A token is replaced by the first of its ``readings`` that is in ``known``, the
    vocabulary of the corpus, and stays as it is if none is.
    """
    text = composed(text)
    if not _FOREIGN.search(text):
        return text, []
    open_words: list[str] = []

    def sub(m: re.Match) -> str:
        may = readings(m.group(0))
        for r in may:
            if r.lower() in known:
                return r
        open_words.extend(r.lower() for r in may)
        return m.group(0)

    return _WORD.sub(sub, text), open_words


def fold(text: str | None) -> str:
    """Lower case without accents, compatibility forms resolved; null gives ''."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    text = _LATIN_MARKS.sub("", unicodedata.normalize("NFKD", text))
    if not text.isascii() and _RARE_RANGE.search(text):
        text = _MARKS.sub("", text)
    return text.lower()


def skeleton(text: str | None) -> str:
    """For parsing: folded, invisible characters gone, look-alikes read as Latin wherever a whole word can be."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    if _ODD.search(text):
        text = composed(text)
        if _FOREIGN.search(text):
            text = _WORD.sub(lambda m: to_latin(m.group(0)) or m.group(0), text)
    return fold(text).replace("ß", "ss").replace("œ", "oe").replace("æ", "ae")
