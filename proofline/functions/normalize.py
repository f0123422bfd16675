"""Unicode normalisation with tamper counts.

The three character classes are mapped by one native ``translate``. Only compatibility composition (NFKC) has no Spark
counterpart: it runs as an Arrow function, and only texts with characters outside ASCII are changed by it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# --- fixed values: confusable letters, invisible characters, odd spaces -------------------------------
CONFUSABLES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԁ": "D", "Ԍ": "G", "Ѡ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i",
    "ј": "j", "ԁ": "d", "һ": "h", "ν": "v", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "α": "a", "ε": "e", "ѵ": "v", "Ꭺ": "A",
    "Ꮃ": "W", "Ꮪ": "S",
}
INVISIBLE = "\u200B\u200C\u200D\u2060\uFEFF\u00AD\u180E"
ODD_SPACES = "\u00A0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u202F\u205F\u3000"
SUSPICIOUS_HOMOGLYPHS, SUSPICIOUS_RATE = 3, 0.002
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "ARABIC", "HEBREW", "DEVANAGARI", "HAN", "HIRAGANA", "KATAKANA", "HANGUL", "THAI")
# --------------------------------------------------------------------------------------------------------

FROM = ODD_SPACES + "".join(CONFUSABLES) + INVISIBLE  # characters beyond TO are deleted
TO = " " * len(ODD_SPACES) + "".join(CONFUSABLES.values())


def mapped(text: Column) -> Column:
    """The text after the character classes, before NFKC."""
    return F.translate(text, FROM, TO)


@pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalized(text: Column, nfkc: bool = True) -> Column:
    return _nfkc(mapped(text)) if nfkc else mapped(text)


def _held(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def counts(text: Column) -> dict[str, Column]:
    """The tamper counts of the original text, its rate and whether it looks tampered with."""
    homoglyphs, invisible, spaces, n = _held(text, "".join(CONFUSABLES)), _held(text, INVISIBLE), _held(text, ODD_SPACES), F.length(text)
    rate = F.coalesce(F.try_divide(homoglyphs + invisible + spaces, n), F.lit(0.0))
    return {
        "homoglyphs_replaced": homoglyphs,
        "invisibles_removed": invisible,
        "odd_spaces_replaced": spaces,
        "n_chars": n,
        "tamper_rate": rate,
        "is_suspicious": (invisible > 0) | ((homoglyphs >= SUSPICIOUS_HOMOGLYPHS) & (rate > SUSPICIOUS_RATE)),
    }


def script_of(character: str) -> str:
    """A coarse script label: the first of the known scripts that the character's Unicode name begins with."""
    name = unicodedata.name(character, "")
    return next(filter(name.startswith, SCRIPTS), "OTHER" if name else "UNKNOWN")


@pandas_udf(ArrayType(StringType()))
def scripts(texts: pd.Series) -> pd.Series:
    """Sorted scripts of the confusables in a text and of its other letters outside ASCII."""

    def of(text: str | None) -> list[str] | None:
        if text is None:
            return None
        odd = {c for c in set(text) if not c.isascii() and (c in CONFUSABLES or (c.isalpha() and c not in INVISIBLE))}
        return sorted({script_of(c) for c in odd})

    return texts.map(of)


def with_report(df: DataFrame, text: str = "text", nfkc: bool = True) -> DataFrame:
    """``df`` with the normalised text in ``clean`` and the tamper counts of the original."""
    return df.withColumns(counts(F.col(text))).withColumn("clean", normalized(F.col(text), nfkc))
