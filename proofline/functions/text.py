"""Words, blocks, sentences and array statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: patterns and abbreviations that define words, blocks and sentences ----------------
WORD = r"[A-Za-zÀ-ɏ]+(?:['’][A-Za-zÀ-ɏ]+)*"
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"
BLOCK_START = r"(?U)^[\s\x1C-\x1F]*(?:[-*+•][\s\x1C-\x1F]|\d+[.)][\s\x1C-\x1F]|#{1,6}[\s\x1C-\x1F]|>[\s\x1C-\x1F])"
BOUNDARY = r"""(?U)(?:(?<=[.!?])|(?<=[.!?]["'”’)\]]))(?<!\.\.)[\s\x1C-\x1F]+(?=[A-Z0-9"'“‘(\[])"""
INITIALS = r"(?U)^(?:[A-Z]\.[\s\x1C-\x1F]*)+$"
CLOSERS = r"""[.!?"'”’)\]]+$"""
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "rev", "gen", "col", "lt", "sgt", "capt", "sr", "jr", "mt", "e.g", "i.e")
MATTR_WINDOW = 50
# ------------------------------------------------------------------------------------------------------

_CUT = "\u0002"


def stripped(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def words(text: Column) -> Column:
    """Word tokens in lower case, with typographic apostrophes made plain."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.replace(F.lower(w), F.lit("’"), F.lit("'")))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def blocks(text: Column) -> Column:
    """Blocks of soft-wrapped lines: a blank line or a list, heading or quote marker begins a new one."""

    def line(raw: Column) -> Column:
        bare = stripped(raw)
        unmarked = stripped(F.regexp_replace(bare, BLOCK_START, ""))
        return F.when(bare == "", F.lit(_CUT)).when(raw.rlike(BLOCK_START), F.concat(F.lit(_CUT), F.when(unmarked == "", bare).otherwise(unmarked))).otherwise(bare)

    joined = F.array_join(F.transform(F.split(text, LINE_ENDS), line), " ")
    return F.filter(F.transform(F.split(joined, _CUT), stripped), lambda b: b != "")


def _ends_open(sentence: Column) -> Column:
    """Whether a fragment's last word is an abbreviation."""
    last = F.lower(F.regexp_extract(F.regexp_replace(sentence, CLOSERS, ""), "[^ ]*$", 0))
    return last.isin(*ABBREVIATIONS)


def _merged(pieces: Column) -> Column:
    """Pieces joined to the one before where that ends in an abbreviation or consists of initials only."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"))

    def step(acc: Column, piece: Column) -> Column:
        last = acc["last"]
        goes_on = (last != "") & (_ends_open(last) | last.rlike(INITIALS))
        return F.struct(
            F.when(goes_on | (last == ""), acc["done"]).otherwise(F.concat(acc["done"], last, F.lit(_CUT))).alias("done"),
            F.when(goes_on, F.concat(last, F.lit(" "), piece)).otherwise(piece).alias("last"),
        )

    return F.split(F.aggregate(pieces, start, step, lambda acc: F.concat(acc["done"], acc["last"])), _CUT)


def sentences(text: Column) -> Column:
    """All sentences, in order. An empty or null text has none."""

    def of_block(block: Column) -> Column:
        pieces = F.filter(F.transform(F.split(block, BOUNDARY), stripped), lambda p: p != "")
        open_ = F.exists(pieces, lambda p: _ends_open(p) | p.rlike(INITIALS))
        return F.when(open_, _merged(pieces)).otherwise(pieces)

    return F.flatten(F.transform(blocks(text), of_block))


def sentence_lengths(sents: Column) -> Column:
    """Word counts of the sentences that have words."""
    return F.filter(F.transform(sents, n_words), lambda n: n > 0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def mean(values: Column) -> Column:
    """0 for an empty array."""
    return F.when(F.size(values) > 0, total(values) / F.size(values)).otherwise(F.lit(0.0))


def stdev(values: Column, average: Column | None = None) -> Column:
    """Sample standard deviation; 0 with fewer than two values."""
    m = mean(values) if average is None else average
    squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    return F.when(F.size(values) > 1, F.sqrt(squares / (F.size(values) - 1))).otherwise(F.lit(0.0))


def variation(average: Column, deviation: Column) -> Column:
    return F.when(average == 0, F.lit(0.0)).otherwise(deviation / average)


def mattr(tokens: Column, window: int = MATTR_WINDOW) -> Column:
    """Mean share of distinct tokens over all windows; of the whole text if it is no longer than one window.

    A token counts in those windows over its place that begin after its last occurrence before. Those occurrences are
    neighbours once tokens are sorted by word and place, so a text is sorted once and no window is built."""
    n = F.size(tokens)
    places = F.array_sort(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

    def windows(held: Column) -> Column:
        def counted(x: Column, k: Column) -> Column:
            before = F.get(held, k - 1)
            last = F.when((k > 0) & (before["t"] == x["t"]), before["i"]).otherwise(F.lit(-1))
            return F.greatest(F.lit(0), F.least(x["i"], n - window) - F.greatest(last, x["i"] - window))

        return F.aggregate(F.transform(held, counted), F.lit(0).cast("bigint"), lambda a, v: a + v)

    distinct = F.element_at(F.transform(F.array(places), windows), 1)  # an array of one, so that the sort is done once
    short = F.size(F.array_distinct(tokens)) / n
    return F.when(n == 0, F.lit(0.0)).when(n <= window, short).otherwise(distinct / F.lit(float(window)) / (n - window + 1))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.when(x > 30, x).otherwise(F.log1p(F.exp(x)))


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal string."""
    gone = F.replace(text, F.lit(needle), F.lit(""))
    return ((F.length(text) - F.length(gone)) / len(needle)).cast("int")


def parsed(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``tokens``, ``sents`` and ``lengths`` of its text column, each built once and used by all features.

    They come from a generator of one row, below which Spark moves no filter: a filter on a score would otherwise repeat
    the parsing for each place the score names."""
    made = F.struct(words(F.col(text)).alias("tokens"), sentences(F.col(text)).alias("sents"))
    df = df.drop("tokens", "sents", "lengths").select("*", F.inline(F.array(made)))
    return df.withColumn("lengths", F.transform(sentence_lengths(F.col("sents")), lambda n: n.cast("double")))
