"""Mechanical perturbations of texts, to measure how scores hold up. Each text is changed by a generator seeded anew,
so equal texts change equally. They serve to test defences and go no further than characters, case and articles."""

from __future__ import annotations

import random
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# --- fixed values: replaced characters and rates -------------------------------------------------------------
TWINS = {
    "a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "s": "ѕ", "x": "х", "y": "у", "i": "і", "j": "ј",
    "d": "ԁ", "h": "һ", "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К",
    "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х", "Y": "У",
}
HIDDEN = ["\u200B", "\u200C", "\u200D", "\u2060"]
BLANKS = ["\u2009", "\u2005", "\u00A0", "\u2002"]
MARKS = {"'": "’", '"': "“", "-": "‑"}
RATES = {"homoglyph": 0.06, "zero_width": 0.04, "whitespace": 0.05, "punctuation": 0.35, "casing": 0.02, "article_drop": 0.30}
# ---------------------------------------------------------------------------------------------------------------

# The order of draws is part of each attack: which characters draw, and that a choice is drawn after a hit.


def homoglyph(text: str, rng: random.Random, rate: float = RATES["homoglyph"]) -> str:
    return re.sub("[" + "".join(TWINS) + "]", lambda m: TWINS[m[0]] if rng.random() < rate else m[0], text)


def zero_width(text: str, rng: random.Random, rate: float = RATES["zero_width"]) -> str:
    return re.sub(" ", lambda m: rng.choice(HIDDEN) + " " if rng.random() < rate else " ", text)


def whitespace(text: str, rng: random.Random, rate: float = RATES["whitespace"]) -> str:
    return re.sub(" ", lambda m: rng.choice(BLANKS) if rng.random() < rate else " ", text)


def punctuation(text: str, rng: random.Random, rate: float = RATES["punctuation"]) -> str:
    hit = [rng.random() < rate for _ in text]
    return "".join(MARKS.get(c, c) if h else c for c, h in zip(text, hit))


def casing(text: str, rng: random.Random, rate: float = RATES["casing"]) -> str:
    flip = lambda c: c.upper() if c.islower() else c.lower()
    return "".join(flip(c) if c.isalpha() and rng.random() < rate else c for c in text)


def article_drop(text: str, rng: random.Random, rate: float = RATES["article_drop"]) -> str:
    fewer = re.sub(r"\b(?:the|a|an)\s+", lambda m: "" if rng.random() < rate else m[0], text, flags=re.IGNORECASE)
    return re.sub(r"\s{2,}", " ", fewer)


ATTACKS: dict[str, Callable[..., str]] = {f.__name__: f for f in (homoglyph, zero_width, whitespace, punctuation, casing, article_drop)}


def attack_names() -> list[str]:
    return sorted(ATTACKS)


def apply(name: str, text: str, seed: int = 0) -> str:
    if name not in ATTACKS:
        raise ValueError(f"unknown attack {name!r}; known: {attack_names()}")
    return ATTACKS[name](text, random.Random(seed))


# --- the same attacks on many texts: with one seed the k-th draw is the same for every text, so draws are made once ----


def _table(pairs: dict[str, str]) -> np.ndarray:
    """By code: the replacement's code, 0 for a character that has none."""
    out = np.zeros(128, np.uint32)
    for a, b in pairs.items():
        out[ord(a)] = ord(b)
    return out


_TWINS, _MARKS = _table(TWINS), _table(MARKS)
# the pattern of article_drop with its first character as a class, which is searched for much faster
_ARTICLE = re.compile(r"[tTaA](?<!\w[tTaA])(?:(?<=[tT])[hH][eE]|(?<=[aA])[nN]?)\s+")
_GAP = re.compile(r"\s\s+")


class _Draws:
    """Whether the k-th draw hits, and what is chosen then, for as many k as were asked for."""

    def __init__(self, seed: int, rate: float, choices: list[str] | None = None) -> None:
        self.rng, self.rate, self.choices, self.drawn, self.at = random.Random(seed), rate, choices, 0, np.zeros(0, np.int64)
        self.chosen: list[str] = []

    def hits(self, n: int) -> np.ndarray:
        """The k below n that hit."""
        if n > self.drawn:
            until, new = max(n, 2 * self.drawn, 4096), []
            for k in range(self.drawn, until):
                if self.rng.random() < self.rate:
                    new.append(k)
                    if self.choices:
                        self.chosen.append(self.rng.choice(self.choices))
            self.at, self.drawn = np.concatenate([self.at, np.array(new, np.int64)]), until
        return self.at[: np.searchsorted(self.at, n)]

    def hit(self, places: np.ndarray) -> np.ndarray:
        """Whether each of the rising places hits."""
        hits = self.hits(int(places[-1]) + 1)
        return np.take(hits, np.searchsorted(hits, places), mode="clip") == places if len(hits) else np.zeros(len(places), bool)


class Attacker:
    """``apply`` with one seed, for many texts."""

    def __init__(self, seed: int = 0) -> None:
        self.draws = {n: _Draws(seed, rate, {"zero_width": HIDDEN, "whitespace": BLANKS}.get(n)) for n, rate in RATES.items()}
        self.letter = np.array([chr(i).isalpha() for i in range(1 << 16)])

    def all(self, text: str) -> dict[str, str]:
        """The text under each attack, by name."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        made = {n: getattr(self, f"_{n}")(text, codes) for n in ("homoglyph", "punctuation", "casing")}
        parts = text.split(" ")
        made |= {n: self._at_spaces(n, parts) for n in ("zero_width", "whitespace")}
        return made | {"article_drop": self._article_drop(text)}

    @staticmethod
    def _replaced(codes: np.ndarray, places: np.ndarray, table: np.ndarray) -> str:
        codes = codes.copy()
        codes[places] = table[codes[places]]
        return codes.tobytes().decode("utf-32-le", "surrogatepass")

    def _homoglyph(self, text: str, codes: np.ndarray) -> str:
        places = np.flatnonzero(_TWINS[np.minimum(codes, 127)])
        return self._replaced(codes, places[self.draws["homoglyph"].hits(len(places))], _TWINS)

    def _punctuation(self, text: str, codes: np.ndarray) -> str:
        places = np.flatnonzero(_MARKS[np.minimum(codes, 127)])
        return self._replaced(codes, places[self.draws["punctuation"].hit(places)], _MARKS) if len(places) else text

    def _casing(self, text: str, codes: np.ndarray) -> str:
        if len(codes) and codes.max() >= len(self.letter):
            places = np.array([i for i, c in enumerate(text) if c.isalpha()], np.int64)
        else:
            places = np.flatnonzero(self.letter[codes])
        out, done = [], 0
        for i in places[self.draws["casing"].hits(len(places))].tolist():
            c = text[i]
            out += (text[done:i], c.upper() if c.islower() else c.lower())
            done = i + 1
        return "".join([*out, text[done:]])

    def _at_spaces(self, name: str, parts: list[str]) -> str:
        draws, between = self.draws[name], [" "] * len(parts)
        for k, c in zip(draws.hits(len(parts) - 1).tolist(), draws.chosen):
            between[k] = c + " " if name == "zero_width" else c
        between[-1] = ""
        return "".join([x for pair in zip(parts, between) for x in pair])

    def _article_drop(self, text: str) -> str:
        draws, out, done = self.draws["article_drop"], [], 0
        found = list(_ARTICLE.finditer(text))
        for k in draws.hits(len(found)).tolist():
            out.append(text[done : found[k].start()])
            done = found[k].end()
        return _GAP.sub(" ", "".join([*out, text[done:]]))


def attacked(name: str, text: Column, seed: int = 0) -> Column:
    """The attacked text; null stays null."""
    if name not in ATTACKS:
        raise ValueError(f"unknown attack {name!r}; known: {attack_names()}")

    @pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else apply(name, t, seed))

    return run(text)


def attack_table(df: DataFrame, text: str = "text", seed: int = 0) -> DataFrame:
    """Each row of ``df`` once per attack, with ``attack`` and ``attacked``. One pass over the texts."""

    @pandas_udf("array<struct<attack:string,attacked:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"attack": n, "attacked": None if t is None else apply(n, t, seed)} for n in attack_names()])

    return df.select("*", F.explode(run(F.col(text))).alias("_x")).select(*df.columns, "_x.attack", "_x.attacked")
