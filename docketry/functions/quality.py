"""How readable an extracted text is."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of the score.
LIMITS = {"cid": 0.02, "nonprintable": 0.05, "word_shape": 0.40, "english": 0.85, "page_chars": 50, "doc_chars": 200}
_EDGE = r"[\p{Punct}“”‘’–—…«»]"


def _nfc(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else t)


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no function for it. Texts without a combining character have nothing to compose."""
    return F.pandas_udf(_nfc, "string")(text)


#: Characters below are their own composition, alone and in any order.
_COMPOSED = r"^[\x{00}-\x{2FF}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{FFFD}]*\z"


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def word_shape(text: Column) -> Column:
    """Share of tokens with two Latin letters in a row; 0 without tokens."""
    t = tokens(text)
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda x: x.rlike("[A-Za-z]{2,}"))) / F.size(t)).otherwise(F.lit(0.0))


def english_share(text: Column) -> Column:
    """Share of tokens with letters whose letters are all ASCII; 1 where no token has letters."""
    t = F.filter(F.transform(tokens(text), lambda x: F.regexp_replace(x, f"^{_EDGE}+|{_EDGE}+$", "")), lambda x: x.rlike(r"\p{L}"))
    plain = F.filter(t, lambda x: ~x.rlike(r"[\p{L}&&[^A-Za-z]]"))
    return F.when(F.size(t) > 0, F.size(plain) / F.size(t)).otherwise(F.lit(1.0))


def with_garble(df: DataFrame, text: str, *, page: bool, normalize: bool = True, prefix: str = "") -> DataFrame:
    """Add chars, cid_ratio, nonprintable_ratio, word_shape_ratio, english_ratio, garbled and reasons (joined by '; ').

    ``page``: the text is one page, else a document. Null counts as empty; an empty text is garbled for
    that reason alone.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    # English share differs under composition only; texts that are composed already do not leave the JVM's values
    base = df.withColumn("_t", t).withColumn("_nfc", F.coalesce(nfc(F.when(~t.rlike(_COMPOSED), t)), t) if normalize else t)
    cid = F.aggregate(F.regexp_extract_all("_t", F.lit(r"\(cid:\d+\)"), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    bad = F.length(F.regexp_replace("_t", "[^�\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""))
    base = base.withColumn("_n", n).withColumn("_cid", cid / F.greatest(n, F.lit(1))).withColumn("_bad", bad / F.greatest(n, F.lit(1)))
    base = base.withColumn("_shape", word_shape(F.col("_t"))).withColumn("_eng", english_share(F.col("_nfc")))
    floor = LIMITS["page_chars"] if page else LIMITS["doc_chars"]
    found = F.array(
        F.when(F.col("_cid") > LIMITS["cid"], "cid-glyph ratio"), F.when(F.col("_bad") > LIMITS["nonprintable"], "non-printable ratio"),
        F.when((F.size(tokens(F.col("_t"))) > 0) & (F.col("_shape") < LIMITS["word_shape"]), "word-shape ratio"), F.when(F.col("_eng") < LIMITS["english"], "english-token ratio"),
        F.when(F.col("_n") < floor, "chars/page" if page else "document length"),
    )
    reasons = F.when(F.col("_n") == 0, F.array(F.lit("empty extraction"))).otherwise(F.filter(found, lambda x: x.isNotNull()))
    out = {"chars": F.col("_n"), "cid_ratio": F.col("_cid"), "nonprintable_ratio": F.col("_bad"), "word_shape_ratio": F.col("_shape"), "english_ratio": F.col("_eng"), "reasons": F.array_join(reasons, "; "), "garbled": F.size(reasons) > 0}
    return base.withColumns({prefix + k: v for k, v in out.items()}).drop("_t", "_nfc", "_n", "_cid", "_bad", "_shape", "_eng")


def quality(text: Column) -> Column:
    """Word shape plus English share; 0 without tokens."""
    return F.when(F.size(tokens(text)) > 0, word_shape(text) + english_share(text)).otherwise(F.lit(0.0))


def f1(left: str | None, right: str | None) -> float:
    a, b = (left or "").split(), (right or "").split()
    if not a and not b:
        return 1.0
    return 2.0 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))


def _f1_all(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([f1(a, b) for a, b in zip(left, right)], dtype="float64")


def token_f1(left: Column, right: Column) -> Column:
    """Token F1 of two texts as multisets: 1 for two empty texts, 0 for one; null counts as empty.

    Counting inside the row in Arrow batches spares the shuffle of all tokens that a join of token counts takes.
    """
    return F.pandas_udf(_f1_all, "double")(left, right)


def html_is_empty(chars: Column, raw_len: Column, *, least: int = 200, ratio: float = 10.0) -> Column:
    """Whether an HTML extraction is too short for its source."""
    return (chars < least) & ((raw_len <= 0) | (raw_len / F.greatest(chars, F.lit(1)) > ratio))


def with_assessment(df: DataFrame, text: str, kind: Column) -> DataFrame:
    """Add flags (joined by ',') and appears_complete: whether a reference text looks whole for its kind."""
    # Least characters by kind, marks of a cut, and the patterns of the flags.
    floors = {"statute": 400, "regulation": 400, "official-policy": 800, "tos": 1500, "guidance": 400, "case-law": 800}
    t = F.coalesce(F.col(text), F.lit(""))
    s = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    floor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv]), kind), F.lit(0))
    markers = ("[truncated]", "[...]", "(continued on next page)", "* * *", "...")
    any_marker = F.lit(False)
    for m in markers:
        any_marker = any_marker | F.contains(t, F.lit(m))
    warn = [
        (F.length(s) < floor, "short-for-kind"), (~s.rlike(r"""(?s)[.!?"')\]]\z"""), "truncation-suspected"), (any_marker, "has-truncation-marker"),
        (F.left(s, F.lit(500)).rlike(r"(?i)\b(excerpt|partial|sample|preview)\b"), "looks-like-excerpt"), (t.rlike(r"(?i)�|\\ufffd"), "encoding-issues"),
        (kind.isin("statute", "regulation") & ~t.rlike(r"(?im)(§\s*\d|\bsection\s+\d|\b\d+(\.\d+)+\b|^\s*\([a-z0-9]+\)\s+\w|^\s*\d+\.\s+\w)"), "no-section-numbers"),
    ]
    info = [
        (t.rlike(r"\b(DRAFT|CONFIDENTIAL|DO NOT DISTRIBUTE|FOR INTERNAL USE)\b"), "has-watermark"),
        (~t.rlike(r"(?i)\b(effective\s+(date|as\s+of|on)|as\s+of\s+\d{4}|last\s+(updated|revised|amended)|version\s+\d)\b|(?i)©\s*\d{4}\b"), "no-effective-date"),
    ]
    flags = F.filter(F.array(*[F.when(c, F.lit(k)) for c, k in warn + info]), lambda x: x.isNotNull())
    bad = F.lit(False)
    for c, _ in warn:
        bad = bad | c
    empty = s == ""
    return df.withColumns({"flags": F.when(empty, F.lit("empty")).otherwise(F.array_join(flags, ",")), "appears_complete": ~(empty | bad)})
