"""The engine's figures and score of a text in plain Python, held equal to the Column expressions by tests.

Attacks make a dozen nearly equal versions of each text. Spark's expressions would parse each of them anew; here what
versions share (sentences, word lists, whole texts) is looked at once. It is for use within Arrow functions.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

from . import combine, detectors, normalize
from . import text as T
from .features import FIRST_PERSON, HEDGES, LONG_SENTENCE, LONG_WORD, NAMES, SHORT_SENTENCE
from .lexicon import LEXICON, RATE_SCALE, SCORE_FLOOR, STRUCTURAL, TRIADS_PER_SENTENCE

KEYS = [*NAMES, "detector_phrases", "detector_stylometry"]

# Python's \s is Java's [\s\x1C-\x1F] under (?U), its \w is [\p{L}\p{N}_]; where Java has \s alone, _S stands for it
_S = r"[^\S\x1c-\x1f]"
_WORD = re.compile(T.WORD)
_BLOCK = re.compile(r"\s*(?:[-*+•]\s|\d+[.)]\s|#{1,6}\s|>\s)")
# the end mark is matched, not looked back at: a search for a class of characters is much faster
_BOUNDARY = re.compile(r"""[.!?](?:["'”’)\]]|(?<!\.\.))\s+(?=[A-Z0-9"'“‘(\[])""")
_INITIALS = re.compile(r"(?:[A-Z]\.\s*)+")
_CLOSERS = """.!?"'”’)]"""
_OUTSIDE = re.compile(r"[^\x00-\x7f]")
_DIGITS = frozenset(map(chr, [0xB2, 0xB3, 0xB9, *range(0x2070, 0x207A), *range(0x2080, 0x208A), *range(0x2460, 0x2469)]))  # besides \p{Nd}
_NO_DIGIT = bytes(set(range(256)) - set(b"0123456789"))
_NO_UPPER = bytes(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_FIRST, _HEDGE, _OPEN = frozenset(FIRST_PERSON), frozenset(HEDGES), frozenset(T.ABBREVIATIONS)
_LONGEST_OPEN = max(map(len, T.ABBREVIATIONS))
_LETTER = re.compile(T.WORD[: T.WORD.index("]") + 1] + "+")
# characters that lower case makes a part of words, or no part any more
_MOVED = frozenset(c for c in map(chr, range(0x80, 0x10000)) if (low := c.lower()) != c and bool(_LETTER.fullmatch(c)) != bool(_LETTER.fullmatch(low)))
# name: what every match contains in lower case, the pattern, the weight
_STRUCTURAL = [
    (needle, re.compile(pattern, flags), next(w for n, _, w in STRUCTURAL if n == name))
    for name, needle, pattern, flags in (
        ("not_only_but_also", "not only", r"(?<!\w)not only(?!\w).{1,120}?(?<!\w)but also(?!\w)", re.I | re.S),
        ("from_x_to_y_frame", "from ", r"[fF](?<!\w[fF])[rR][oO][mM] \w+(?: \w+)? [tT][oO] \w+(?: \w+)?, ", 0),
        ("bullet_with_bold_lead", "**", rf"^{_S}*[-*•]{_S}*\*\*[^*]+\*\*[:,]", re.M),
        ("numbered_bold_lead", "**", rf"^{_S}*\d+\.{_S}*\*\*[^*]+\*\*[:,]", re.M),
        ("colon_triad_header", "#", rf"^#{{1,4}}{_S}", re.M),
    )
]
_AND = re.compile(r", [aA][nN][dD] \w[\w'’-]*")
_MIDDLE = re.compile(r" \w[\w'’-]*(?: \w[\w'’-]*)?")
_BY_WORD: dict[str, list[str]] = {}
for _p in LEXICON:
    _BY_WORD.setdefault(max(re.findall(r"\w+", _p), key=len), []).append(_p)
_ORDER = {p: k for k, (p, _) in enumerate(detectors._phrases())}
_JOINING = "\u00D7\u00F7\u212A\u0130"  # times, divided by, the Kelvin sign, dotted I: with these a phrase's words need not be words of the text
_MAPPED = dict(zip(normalize.FROM, [*normalize.TO, *[""] * (len(normalize.FROM) - len(normalize.TO))]))
_FROM = re.compile(f"[{normalize.FROM}]")


def normalized(text: str) -> str:
    if text.isascii():
        return text
    for c in set(_FROM.findall(text)):
        text = text.replace(c, _MAPPED[c])
    return unicodedata.normalize("NFKC", text)


def _ends_open(piece: str) -> bool:
    piece = piece.rstrip(_CLOSERS)
    return piece[piece.rfind(" ") + 1 :].lower() in _OPEN


def _initials(piece: str) -> bool:
    return piece[1:2] == "." and _INITIALS.fullmatch(piece) is not None


def _blocks(text: str) -> list[str]:
    blocks: list[list[str]] = [[]]
    for raw in text.splitlines():
        bare = raw.strip()
        if not bare:
            blocks.append([])
        elif _BLOCK.match(raw):
            mark = _BLOCK.match(bare)
            blocks.append([(bare[mark.end() :].strip() or bare) if mark else bare])
        else:
            blocks[-1].append(bare)
    joined = [" ".join(b) for b in blocks]
    if T._CUT in text:
        joined = [part.strip() for b in joined for part in b.split(T._CUT)]
    return [b for b in joined if b]


def sentences(text: str) -> list[str]:
    out = []
    for block in _blocks(text):
        pieces, start, open_ = [], 0, False
        for m in _BOUNDARY.finditer(block):
            mark, piece = m.start(), block[start : m.end()].rstrip()
            if not open_ and (mark - max(block.rfind(" ", start, mark), start - 1) <= _LONGEST_OPEN + 1 or block[mark - 1] in _CLOSERS or piece[1:2] == "."):
                open_ = _ends_open(piece) or _initials(piece)
            pieces.append(piece)
            start = m.end()
        pieces.append(block[start:])
        if open_:
            merged, pieces = pieces, []
            last = merged[0]
            for piece in merged[1:]:
                if _ends_open(last) or _initials(last):
                    last = f"{last} {piece}"
                else:
                    pieces.append(last)
                    last = piece
            pieces.append(last)
        out += pieces
    return out


def words(text: str) -> list[str]:
    found = _WORD.findall(text)
    return "\n".join(found).lower().replace("’", "'").split("\n") if found else found


def mattr(tokens: list[str], window: int = T.MATTR_WINDOW) -> float:
    n = len(tokens)
    if n <= window:
        return len(set(tokens)) / n if n else 0.0
    seen: dict[str, int] = {}
    get, ends, twice = seen.get, n - window, 0
    for i, t in enumerate(tokens):  # windows that hold an occurrence and the one before it
        last = get(t)
        seen[t] = i
        if last is not None and i - last < window:
            begin, end = i - window + 1, last if last < ends else ends
            if begin <= end:
                twice += end - (begin if begin > 0 else 0) + 1
    return ((ends + 1) * window - twice) / float(window) / (ends + 1)


def _spread(values: dict[int, int], n: int) -> tuple[float, float]:
    """Mean and sample deviation of whole numbers (value: how often), from exact sums."""
    s = sum([v * c for v, c in values.items()])
    if n < 2:
        return s / n, 0.0
    return s / n, math.sqrt((n * sum([v * v * c for v, c in values.items()]) - s * s) / (n * (n - 1)))


def _word_figures(tokens: tuple[str, ...], different: set[str]) -> dict[str, float]:
    n, lens = len(tokens), Counter(map(len, tokens))
    mean, sd = _spread(lens, n)
    held = lambda among: sum(map(tokens.count, among & different))
    short = {t for t in different if "'" in t}
    return {
        "mattr": mattr(tokens), "mean_word_len": mean, "sd_word_len": sd, "long_word_rate": sum([c for v, c in lens.items() if v >= LONG_WORD]) / n,
        "contraction_per_kw": held(short) * (1000.0 / n), "first_person_per_kw": held(_FIRST) * (1000.0 / n), "hedge_per_kw": held(_HEDGE) * (1000.0 / n),
        "log_n_words": math.log1p(n),
    }


def triads(text: str) -> int:
    """Matches of the triad pattern. Each ends in ", and" and a word; the words before are between the commas before it,
    so that only these places are looked at."""
    n = end = 0
    for m in _AND.finditer(text):
        second = m.start()
        first = text.rfind(",", end, second)
        if first < 0 or not _MIDDLE.fullmatch(text, first + 1, second):
            continue
        start = k = first
        while k > end and (text[k - 1].isalnum() or text[k - 1] in "_'’-"):
            k -= 1
            if text[k].isalnum() or text[k] == "_":
                start = k
        if start < first and not (start > 0 and (text[start - 1].isalnum() or text[start - 1] == "_")):
            n, end = n + 1, m.end()
    return n


def _word_at(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")


def _lexical(lowered: str, text: str, tokens: set[str]) -> float:
    """Weight of the lexicon's hits. Only phrases whose longest word the text has are looked for."""
    if any(c in text for c in _JOINING):
        return sum(LEXICON[p] * n for p, n in detectors.claim(lowered).items())
    total = 0.0
    for phrase in sorted([p for w in _BY_WORD.keys() & tokens for p in _BY_WORD[w]], key=_ORDER.__getitem__):
        at = lowered.find(phrase)
        while at >= 0:
            end = at + len(phrase)
            if _word_at(lowered, at - 1) or _word_at(lowered, end):
                at = lowered.find(phrase, at + 1)
            else:
                total += LEXICON[phrase]
                lowered = f"{lowered[:at]}\u0001{lowered[end:]}"
                at = lowered.find(phrase, at + 1)
    return total


def _logistic(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x)) if x > -700 else 0.0


class Scorer:
    """Figures of texts that may have much in common; ``forget`` between unrelated texts keeps it small."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self._words: dict[str, list[str]] = {}
        self._figures: dict[tuple[str, ...], tuple[dict[str, float], set[str]]] = {}

    def figures(self, text: str) -> dict[str, float] | None:
        """``KEYS`` by name, None for a text without words."""
        sents = sentences(text)
        others = [] if text.isascii() else _OUTSIDE.findall(text)
        plain = _MOVED.isdisjoint(others)  # then words may be found in the text in lower case, which more versions share
        tokens: list[str] = []
        lengths = []
        if "’" in text and plain:
            sents = [s.replace("’", "'") for s in sents]
        for s in sents:
            if plain:
                s = s.lower()
            w = self._words.get(s)
            if w is None:
                w = self._words[s] = _WORD.findall(s) if plain else words(s)
            if w:
                tokens += w
                lengths.append(len(w))
        n = len(tokens)
        if not n:
            return None
        known = self._figures.get(key := tuple(tokens))
        if known is None:
            whole = set(tokens)
            known = self._figures[key] = _word_figures(key, whole), whole.union(*[t.split("'") for t in whole if "'" in t])
        out = dict(known[0])
        mean, sd = _spread(Counter(lengths), len(lengths))
        count, per_kw, size, k = text.count, 1000.0 / n, len(text), len(lengths)
        codes = text.encode("ascii", "ignore")
        digits, upper = len(codes.translate(None, _NO_DIGIT)), len(codes.translate(None, _NO_UPPER))
        quotes, dashes = count('"'), count(" -- ")
        if others:
            digits += sum([c.isdecimal() or c in _DIGITS for c in others])
            upper += sum(map(str.isupper, others))
            quotes, dashes = quotes + count("“"), dashes + count("—")
        out |= {
            "mean_sentence_len": mean, "sd_sentence_len": sd, "burstiness": sd / mean, "short_sentence_rate": sum([v <= SHORT_SENTENCE for v in lengths]) / k,
            "long_sentence_rate": sum([v >= LONG_SENTENCE for v in lengths]) / k, "em_dash_per_kw": dashes * 1000.0 / n,
            "semicolon_per_kw": count(";") * per_kw, "colon_per_kw": count(":") * per_kw, "comma_per_kw": count(",") * per_kw, "question_per_kw": count("?") * per_kw,
            "exclaim_per_kw": count("!") * per_kw, "quote_per_kw": quotes * per_kw, "paren_per_kw": count("(") * per_kw, "digit_rate": digits / size, "uppercase_rate": upper / size,
        }
        top = bottom = 0.0
        for name, (mid, scale, high, weight) in detectors.STYLOMETRY.items():
            if k >= detectors.MIN_SENTENCES or name not in ("burstiness", "short_sentence_rate"):
                x = (out[name] - mid) / scale
                top, bottom = top + weight * _logistic(x if high else -x), bottom + weight
        out["detector_stylometry"] = min(1.0, max(0.0, top / bottom))
        lowered = text.lower()
        weighted = _lexical(lowered, text, known[1]) + sum([len(p.findall(text)) * w for needle, p, w in _STRUCTURAL if needle in lowered])
        over = triads(text) - TRIADS_PER_SENTENCE * max(len(sents), 1)
        weighted += over if over > 30 else math.log1p(math.exp(over))
        score = SCORE_FLOOR + (1.0 - SCORE_FLOOR) * (1.0 - math.exp(-(weighted * 1000.0 / n) / RATE_SCALE))
        out["detector_phrases"] = min(1.0, max(0.0, score))
        return out

    def score(self, text: str, linear: tuple[float, list[tuple[str, float]]] | None = None) -> float:
        """The blend of the primary, if there is one (by ``linear``), and the corroborators; 0.5 without words."""
        f = self.figures(text)
        if f is None:
            return 0.5
        mean = (f["detector_phrases"] + f["detector_stylometry"]) / 2
        if linear is None:
            return mean
        x, weights = linear
        for k, w in weights:
            x += w * f[k]
        return combine.PRIMARY_WEIGHT * _logistic(x) + (1 - combine.PRIMARY_WEIGHT) * mean


def linear(model) -> tuple[float, list[tuple[str, float]]]:
    """A logistic model's constant and weights for figures that aren't standardised."""
    scale = [model.scale.get(k, (0.0, 1.0)) for k in model.keys]
    return model.bias - sum(w * m / s for w, (m, s) in zip(model.weights, scale)), [(k, w / s) for k, w, (_, s) in zip(model.keys, model.weights, scale)]
