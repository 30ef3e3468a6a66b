"""One form for texts that look the same and differ in their characters."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.runtime import materialize, salted_join

# Letters of other scripts that cannot be told from a Latin letter by eye.
CYRILLIC_TWINS = {
    "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "w": "ԝ", "x": "х", "y": "у",
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х", "Y": "Ү",
}
GREEK_TWINS = {
    "o": "ο", "v": "ν",
    "A": "Α", "B": "Β", "E": "Ε", "Z": "Ζ", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "Y": "Υ", "X": "Χ",
}
# Letters of scripts that these texts hold as stray letters only; each is written like the Latin one.
STRAY_TWINS = {
    "h": "հ", "o": "օⲟ", "p": "ⲣ", "c": "ⲥ", "A": "Ꭺꓮ", "B": "ᏴꓐⲂ", "C": "ᏟꓚⲤ", "D": "Ꭰꓓ", "E": "Ꭼꓰ", "F": "ꓝ", "G": "Ꮐꓖ", "H": "ᎻꓧⲎ", "I": "ꓲⲒ", "J": "Ꭻꓙ", "K": "ᏦꓗⲔ", "L": "Ꮮꓡ",
    "M": "ᎷꓟⲘ", "N": "ꓠⲚ", "O": "ՕꓳⲞ", "P": "ᏢꓑⲢ", "R": "Ꭱꓣ", "S": "Ꮪꓢ", "T": "ᎢꓔⲦ", "U": "Սꓴ", "V": "Ꮩꓦ", "W": "Ꮃꓪ", "X": "ꓫⲬ", "Y": "ꓬ", "Z": "Ꮓꓜ", "v": "ѵ",
}
# Signs that are written like several others; the word around them tells which one a reader sees.
READINGS = {
    **dict.fromkeys("Ӏӏǀ∣׀", "lI|"), **dict.fromkeys("߀०੦૦௦౦೦൦๐໐၀ဝ", "oO0"), "З": "З3", "Ⳓ": "6б", "ƽ": "s5",
}
#: Other pairs that look the same: hyphens.
_OTHER = {0x2010: "-", 0x2011: "-"}
#: Letters that join, so that an invisible joiner or non-joiner between two of them changes how they are drawn, and the same for pictures.
_JOINING = "\u0600-\u07bf\u0840-\u08ff\u0900-\u0dff\u0f00-\u109f\u1780-\u18af\u2600-\u27bf\ufe0f\U0001f000-\U0001faff"
_SCRIPTS = ("latin", "cyrillic", "greek")
_SWITCH = 12.0  # cost of changing the script inside a word
_TOKENS = re.compile("(?:[^\\W_\u0300-\u036f]|[|∣׀])(?:[^\\W_]|[\u0300-\u036f|∣׀])*")


@lru_cache(maxsize=1)
def _first_table() -> dict[int, str | None]:
    """Compatibility normalisation that keeps the look: widths and spaces alike, ligatures spelled out, no invisible characters."""
    table: dict[int, str | None] = dict(_OTHER)
    for cp in [*range(0x80, 0x10000), *range(0xE0000, 0xE01F0)]:
        ch = chr(cp)
        cat, kind = unicodedata.category(ch), unicodedata.decomposition(ch).split(" ")[0]
        if cp in (0x200C, 0x200D):
            continue  # see _joiners
        if cat == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            table[cp] = None
        elif cat == "Zs":
            table[cp] = " "
        elif kind in ("<wide>", "<narrow>") or 0xFB00 <= cp <= 0xFB06 or 0x2160 <= cp <= 0x217F:  # and Roman numerals, which are letters
            table[cp] = unicodedata.normalize("NFKC", ch)
    return table


_TO_LATIN = {ord(c): k for twins in (CYRILLIC_TWINS, GREEK_TWINS, STRAY_TWINS) for k, v in twins.items() for c in v}
#: One sign stands for all that are read alike.
_FIRST_READ = {ord(c): next(x for x in READINGS if READINGS[x] == r) for c, r in READINGS.items()}
_UNSURE = re.compile("[" + "".join(READINGS) + "]")
_OPTIONS: dict[str, tuple[str | None, str | None, str | None]] = {
    c: (c, CYRILLIC_TWINS.get(c), GREEK_TWINS.get(c)) for c in {*CYRILLIC_TWINS, *GREEK_TWINS}
}


def script_of(ch: str) -> int | None:
    o = ord(ch)
    if o < 0x250 and ch.isalpha() or 0x1E00 <= o < 0x1F00:
        return 0
    return 1 if 0x400 <= o < 0x530 else 2 if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else None


_TAGS = re.compile("[\U000e0000-\U000e01ef]")  # invisible tags and selectors outside the first plane


@lru_cache(maxsize=2)
def _mapped(latin: bool):
    """Pattern of the characters that the tables change, and what they change them to."""
    table = {chr(k): v or "" for k, v in _first_table().items()}
    if latin:
        table |= {chr(k): v for k, v in _TO_LATIN.items()}
    return re.compile("[" + "".join(re.escape(c) for c in sorted(table) if c <= "\uffff") + "]"), table  # a class within the first plane is a bitmap


_RUNS = re.compile("[\u200c\u200d]{2,}")
_BARE = re.compile(f"(?<![{_JOINING}])[\u200c\u200d]|[\u200c\u200d](?![{_JOINING}])")


def _joiners(text: str) -> str:
    """Joiners and non-joiners go where nothing can join, and stay where a reader sees what they do."""
    return _BARE.sub("", _RUNS.sub(lambda m: m[0][0], text)) if "\u200c" in text or "\u200d" in text else text


def _replaced(text: str, latin: bool) -> str:
    text = _joiners(text)
    pattern, table = _mapped(latin)
    if _TAGS.search(text):
        text = _TAGS.sub("", text)
    return pattern.sub(lambda m: table[m[0]], text) if pattern.search(text) else text


def skeleton(text: str) -> str:
    """Every character as the first of those that look like it; letters and their marks apart; signs with several readings as one sign."""
    if text.isascii():
        return text
    form = unicodedata.normalize("NFD", _replaced(text, False)).translate(_TO_LATIN) if _OTHER_SCRIPTS.search(text) else unicodedata.normalize("NFD", _replaced(text, True))
    return form.translate(_FIRST_READ) if _UNSURE.search(form) else form


_SIMPLE = re.compile(r"[^\W_]+")
_ASCII_WORDS = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_OTHER_SCRIPTS = re.compile("[Ͱ-ԯἀ-῿]")
_DIGIT = re.compile(r"\d")


def words_of(texts) -> Counter:
    """Words and numbers of texts, each with its count."""
    words: Counter = Counter()
    for t in texts:
        if not t:
            continue
        if t.isascii():
            words.update(t.encode().translate(_ASCII_WORDS).split())
        else:
            words.update(_SIMPLE.findall(unicodedata.normalize("NFC", _replaced(t, False))))
    return words


def pairs_of(words: Counter) -> Counter:
    """Pairs of neighbouring base letters, with word ends, over words of one script that hold a letter of no other look.

    Capitals count apart and once more as small letters, all digits are one; numbers count for every script.
    """
    pairs: Counter = Counter()
    for w, n in words.items():
        w = w.decode() if isinstance(w, bytes) else re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", w))
        w = _DIGIT.sub("0", w)
        kinds = {script_of(c) for c in w if c != "0"}
        if not kinds:
            homes = range(3)
        elif len(kinds) == 1 and (k := kinds.pop()) is not None and any(c not in _OPTIONS and ord(c) not in _TO_LATIN and c not in READINGS for c in w):
            homes = (k,)
        else:
            continue
        low = w.lower()
        for k in homes:
            for a, b in zip("^" + w, w + "$"):
                pairs[(k, a + b)] += n
            if low != w:
                for a, b in zip("^" + low, low + "$"):
                    pairs[(k, a + b)] += n
    return pairs


def pair_counts(texts) -> Counter:
    return pairs_of(words_of(texts))


def script_model(docs: DataFrame, text: str = "text") -> dict[tuple[int, str], float]:
    """Log probabilities of letter pairs by script, counted over all texts.

    Each partition sends one count per pair of letters of a script, at most a few ten thousand in all
    (letters of three alphabets squared), so the model's size does not grow with the texts.
    """

    def count(batches):
        total, words = Counter(), Counter()
        for b in batches:
            words.update(words_of(b.iloc[:, 0]))
            if len(words) > 100_000:
                total.update(pairs_of(words))
                words.clear()
        total.update(pairs_of(words))
        import pandas as pd

        yield pd.DataFrame({"script": [k for k, _ in total], "pair": [p for _, p in total], "n": list(total.values())}).astype({"script": "int64", "n": "int64", "pair": "str"})

    rows = docs.select(text).mapInPandas(count, "script bigint, pair string, n bigint").groupBy("script", "pair").agg(F.sum("n").alias("n")).collect()
    heads: Counter = Counter()
    for r in rows:
        heads[(r.script, r.pair[0])] += r.n
    return {(r.script, r.pair): math.log((r.n + 0.1) / (heads[(r.script, r.pair[0])] + 20)) for r in rows}


class Decoder:
    """Viterbi search over look-alike lattices, one state per script and last letter; results of words are kept."""

    def __init__(self, model: dict[tuple[int, str], float]):
        self.model, self.known = model, {}

    def _step(self, script: int, pair: str) -> float:
        """Log probability of a letter after another in a script; a pair unseen in its case counts as in small letters, less so."""
        got = self.model.get((script, pair))
        if got is None:
            got = self.model.get((script, pair.lower()), -12.0) - 2.0
        return got

    @staticmethod
    def _readings(ch: str, scripts: tuple[int, ...]):
        """(script or None for signs of all scripts, spelling) of what a sign may be."""
        for c in READINGS.get(ch, ch):
            if c in _OPTIONS:
                yield from ((s, x) for s, x in enumerate(_OPTIONS[c]) if x is not None and s in scripts)
            elif (s := script_of(c)) is not None:
                yield s, c
            else:
                yield None, c

    def word(self, word: str, home: int, scripts: tuple[int, ...] = (0, 1, 2)) -> str:
        """The likeliest spelling of a skeleton word in a text whose plain letters are of script ``home``, all its letters of one script if it can be."""
        key = (word, home, scripts)
        if (got := self.known.get(key)) is not None:
            return got
        if len(self.known) > 200_000:
            self.known.clear()
        best: dict[tuple[int, str], tuple[float, str]] = {(s, "^"): (0.0 if s == home else -8.0, "") for s in scripts}
        for ch in word:
            if "̀" <= ch <= "ͯ":
                best = {k: (v, out + ch) for k, (v, out) in best.items()}
                continue
            step: dict[tuple[int, str], tuple[float, str]] = {}
            for s, spelled in self._readings(ch, scripts):
                shown = "0" if spelled.isdigit() else spelled
                for (p, last), (v, out) in best.items():
                    to = p if s is None else s
                    score = v + (self._step(to, last + shown) if p == to or last == "^" else -12.0 - _SWITCH) - (_SWITCH if p != to and last == "^" else 0)
                    if (to, shown) not in step or score > step[to, shown][0]:
                        step[to, shown] = (score, out + spelled)
            best = step
        ends = [(v + self._step(s, last + "$"), -s, out) for (s, last), (v, out) in best.items()]
        # equal scores: the home of the first script, then the reading named first
        got = max(ends, key=lambda e: e[:2])[2] if ends else word
        self.known[key] = got
        return got

    def canonical(self, text: str) -> str:
        """The canonical form of a text.

        Its words are searched under the letters they have in common with words of the same look. A text
        whose skeleton has no letter of another script has one consistent script, Latin, so only the words
        with signs of several readings are left to search; every other text is searched word by word.
        """
        if text.isascii() or not _mapped(True)[0].search(text) and not _OTHER_SCRIPTS.search(text) and not _TAGS.search(text) and not _UNSURE.search(text) and "\u200c" not in text and "\u200d" not in text and unicodedata.is_normalized("NFC", text):
            return text
        s = skeleton(text)
        if not _OTHER_SCRIPTS.search(_UNSURE.sub("", s)):
            if _UNSURE.search(s):
                s = _TOKENS.sub(lambda m: self.word(m[0], 0, (0,)) if _UNSURE.search(m[0]) else m[0], s)
            return unicodedata.normalize("NFC", s)
        plain = Counter(script_of(c) for c in s if c not in _OPTIONS and c.isalpha())
        home = max(range(3), key=lambda k: (plain.get(k, 0), -k))
        return unicodedata.normalize("NFC", _TOKENS.sub(lambda m: self.word(m[0], home), s))


def canonical_texts(docs: DataFrame, *, keep_text: bool = True) -> DataFrame:
    """(doc_id, look, raw, canonical): the canonical form of every text, and digests of it and of the text itself.

    Null texts count as empty. Digests have 128 bits. Without ``keep_text`` the texts stay where they
    are read and only digests travel.
    """
    model = docs.sparkSession.sparkContext.broadcast(script_model(docs))

    def decode(batches):
        import pandas as pd

        decoder = Decoder(model.value)
        digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            texts = [t or "" for t in b["text"]]
            forms = [decoder.canonical(t) for t in texts]
            raw = [digest(t) for t in texts]
            out = {"doc_id": b["doc_id"], "look": [r if f is t else digest(f) for r, f, t in zip(raw, forms, texts)], "raw": raw}
            yield pd.DataFrame(out | ({"canonical": forms} if keep_text else {}))

    schema = "doc_id bigint, look binary, raw binary" + (", canonical string" if keep_text else "")
    return docs.select("doc_id", "text").mapInPandas(decode, schema)


def _variants(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digests of every text, one row per look and exact string with its smallest doc_id and number)."""
    digests = materialize(canonical_texts(docs, keep_text=False))
    return digests, digests.groupBy("look", "raw").agg(F.min("doc_id").alias("variant_id"), F.count("*").alias("copies"))


def look_classes(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, class_id, variant_id, links), the smallest ids of its look and of its exact string, and the number of documents that look the same and are another string."""
    digests, variants = _variants(docs)
    looks = variants.groupBy("look").agg(F.min("variant_id").alias("class_id"), F.sum("copies").alias("all"))
    rows = variants.join(looks, "look").select("look", "raw", "variant_id", "class_id", (F.col("all") - F.col("copies")).alias("links"))
    return salted_join(digests.select("doc_id", "look", "raw"), rows, ["look", "raw"], salt_on=F.col("doc_id")).select("doc_id", "class_id", "variant_id", "links")


def look_pairs(docs: DataFrame) -> DataFrame:
    """Pairs (doc_a, doc_b), smaller first, of documents that look the same and are not the same string.

    Strings, not documents, are paired: a group of exact copies, however large, is one row of the variants,
    and drops out where its look has no other string. Each pair of strings is then expanded to the
    documents of one side and of the other by equi-joins on the string's digest, spread over salts, so the
    work follows the result. Documents with null or empty text look alike but are the same string.
    """
    digests, variants = _variants(docs)
    several = variants.groupBy("look").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where(F.col("a") != F.col("b")).select("look")
    strings = materialize(variants.join(several, "look", "left_semi").select("look", "raw"))
    pairs = strings.withColumnRenamed("raw", "raw_a").join(strings.withColumnRenamed("raw", "raw_b"), "look").where(F.col("raw_a") < F.col("raw_b")).select("raw_a", "raw_b")
    docs_of = digests.join(strings.select("raw"), "raw", "left_semi").select("doc_id", "raw")
    left = salted_join(docs_of.select(F.col("doc_id").alias("one"), F.col("raw").alias("raw_a")), pairs, ["raw_a"], salt_on=F.col("one")).select("one", "raw_b")
    both = salted_join(docs_of.select(F.col("doc_id").alias("two"), F.col("raw").alias("raw_b")), left, ["raw_b"], salt_on=F.col("two"))
    return both.select(F.least("one", "two").alias("doc_a"), F.greatest("one", "two").alias("doc_b"))
