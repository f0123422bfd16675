"""Problem 2: per-document text statistics and fixed-threshold rules.

All figures are built-in Spark expressions over one scan. Disguises (look-alike letters, invisible characters, unusual
spaces) are undone with ``translate`` before counting, so a disguised text has its own figures.

The rules are published fixed thresholds; each that fails is recorded in ``reasons``, and ``passes`` tells whether none
did. They are of two sorts:

``PROSE_RULES``   what running text must meet in any layout: two or more occurrences of a language's stop words (any of
                  ``STOP_WORDS``' languages), words of common length, mostly words with letters, few marks, not nearly
                  all lines with bullets. A text that fails one is not prose, and ``kind`` names what it is instead.
the others        length, closing punctuation, short and trailing lines. Prose that is short, wrapped or unpunctuated
                  fails them and is still prose: they count for ``passes`` only.

Languages written without blanks between words are not covered: their texts fail the rules on words.
A null or empty text has zero counts and null ratios, reasons ["empty"], and is not prose (kind "junk").
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canon import INVISIBLE, multi_map, single_map

# --- fixed values: common English words; the stop words and thresholds of published filter rules ------
COMMON = (
    "i me my myself we our ours ourselves you your yours yourself he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does "
    "did a an the and but if or because as until while of at by with about against between into through during before after above "
    "below to from up down in out on off over under than so not no nor only each both all any such same every some "
    "upon within without near along beside behind beyond inside across around past whereas although though"
).split()
STOP_WORDS = {
    "en": ("the", "be", "to", "of", "and", "that", "have", "with"),
    "fr": ("les", "des", "est", "que", "une", "dans", "pour", "pas"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "mit"),
    "es": ("los", "las", "que", "una", "por", "con", "del", "para"),
    "it": ("che", "non", "per", "con", "una", "del", "della", "sono"),
    "nl": ("het", "een", "van", "dat", "niet", "met", "voor", "zijn"),
    "pt": ("que", "uma", "para", "com", "não", "dos", "por", "mais"),
}
MIN_WORDS, MIN_MEAN_LENGTH, MAX_MEAN_LENGTH = 50, 3.0, 10.0
MAX_SYMBOLS_PER_WORD, MAX_BULLET_LINES, MAX_ELLIPSIS_LINES = 0.1, 0.9, 0.3
MIN_ALPHABETIC_WORDS, MIN_STOP_WORDS = 0.8, 2
MIN_TERMINAL_LINES, MAX_SHORT_LINES, SHORT_LINE = 0.12, 0.67, 30
PROSE_RULES = ("empty", "stop_words", "mean_word_length", "alphabetic_words", "symbols_per_word", "bullet_lines")
# --------------------------------------------------------------------------------------------------------

_NOT_WORD = r"[^\p{L}\p{M}\p{N}'’-]+"


def plain(text: Column) -> Column:
    """``text`` with look-alike letters, unusual spaces and ligatures mapped and invisible characters removed."""
    table = single_map()
    several = F.translate(text, "".join(table) + INVISIBLE, "".join(table.values()))
    for k, v in multi_map().items():
        several = F.replace(several, F.lit(k), F.lit(v))
    one = F.translate(text, "".join(table) + INVISIBLE, "".join(table.values()))
    return F.when(text.rlike("[" + "".join(multi_map()) + "]"), several).when(text.rlike(r"[^\x00-\x7F]"), one).otherwise(text)


def _held(words: str, own) -> Column:
    """How many of the words are among ``own``, repeated ones counted again."""
    return F.size(F.filter(words, lambda w: w.isin(*own)))


def statistics(df: DataFrame, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the figures of each text. Other columns of ``df`` are not read."""
    names = [F.col(f"`{k}`") for k in keep]
    base = df.select(*names, plain(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    words = F.filter(F.split(F.lower("__t"), _NOT_WORD), lambda w: w != "")
    lines = F.filter(F.split("__t", "\n"), lambda line: F.trim(line) != "")
    # a generator of one row: Spark moves no filter below it, so that texts are split once for all figures
    base = base.select(*names, F.inline(F.array(F.struct(F.col("__t"), words.alias("__w"), lines.alias("__lines")))))
    share = lambda part, whole: F.expr(f"try_divide({part}, {whole})")
    counted = base.select(
        *[F.col(f"`{k}`") for k in keep],
        F.length("__t").alias("n_chars"),
        F.size("__w").alias("n_words"),
        F.size("__lines").alias("n_lines"),
        F.length(F.array_join("__w", "")).alias("__letters"),
        _held("__w", COMMON).alias("__common"),
        F.greatest(*[_held("__w", own) for own in STOP_WORDS.values()]).alias("n_stop_words"),
        F.size(F.filter("__w", lambda w: w.rlike(r"\p{L}"))).alias("__alphabetic"),
        F.size(F.array_distinct("__w")).alias("__distinct"),
        F.length(F.regexp_replace("__t", r"[\p{L}\p{M}\p{N}\s.,;:!?'\"“”‘’()—–-]+", "")).alias("__symbols"),
        F.regexp_count("__t", F.lit(r"[#…]|\.\.\.")).alias("__marks"),
        F.size(F.filter("__lines", lambda line: line.rlike(r"^\s*(?:[-*+•‣▪]|\d{1,3}[.)])\s+\S"))).alias("__bullets"),
        F.size(F.filter("__lines", lambda line: line.rlike(r"[.!?…][\"'”’)\]]*\s*$"))).alias("__terminal"),
        F.size(F.filter("__lines", lambda line: line.rlike(r"(?:…|\.\.\.)\s*$"))).alias("__trailing"),
        F.size(F.filter("__lines", lambda line: F.length(line) <= SHORT_LINE)).alias("__short"),
        F.size(F.filter("__lines", lambda line: line.rlike(r"\t|\s\|\s|\S {3,}\S"))).alias("__cells"),
        F.regexp_count("__t", F.lit(r'(?:^|[;|,{\n])\s*"?[\p{L}_]+"?\s*[:=]')).alias("n_fields"),
        F.size(F.filter("__w", lambda w: w.rlike(r"^\p{N}+$"))).alias("__numbers"),
    )
    return counted.select(
        *[F.col(f"`{k}`") for k in keep], "n_chars", "n_words", "n_lines", "n_stop_words", "n_fields",
        share("__letters", "n_words").alias("mean_word_length"), share("__common", "n_words").alias("common_word_share"),
        share("__alphabetic", "n_words").alias("alphabetic_word_share"), share("__numbers", "n_words").alias("number_share"),
        share("__distinct", "n_words").alias("distinct_word_share"), share("__symbols", "n_chars").alias("symbol_ratio"),
        share("__marks", "n_words").alias("marks_per_word"), share("__bullets", "n_lines").alias("bullet_line_share"),
        share("__terminal", "n_lines").alias("terminal_line_share"), share("__trailing", "n_lines").alias("ellipsis_line_share"),
        share("__short", "n_lines").alias("short_line_share"), share("__cells", "n_lines").alias("cell_line_share"),
    )


def judged(stats: DataFrame) -> DataFrame:
    """``stats`` with ``reasons`` (the rules that fail, in a fixed order), ``is_prose`` and ``kind``."""
    c = F.col
    fails = {
        "empty": c("n_words") == 0,
        "too_few_words": (c("n_words") > 0) & (c("n_words") < MIN_WORDS),
        "mean_word_length": (c("mean_word_length") < MIN_MEAN_LENGTH) | (c("mean_word_length") > MAX_MEAN_LENGTH),
        "symbols_per_word": c("marks_per_word") > MAX_SYMBOLS_PER_WORD,
        "bullet_lines": c("bullet_line_share") > MAX_BULLET_LINES,
        "ellipsis_lines": c("ellipsis_line_share") > MAX_ELLIPSIS_LINES,
        "alphabetic_words": c("alphabetic_word_share") < MIN_ALPHABETIC_WORDS,
        "stop_words": (c("n_words") > 0) & (c("n_stop_words") < MIN_STOP_WORDS),
        "terminal_lines": c("terminal_line_share") < MIN_TERMINAL_LINES,
        "short_lines": c("short_line_share") > MAX_SHORT_LINES,
    }
    failed = {k: F.coalesce(v, F.lit(False)) for k, v in fails.items()}
    prose = ~reduce(Column.__or__, [failed[k] for k in PROSE_RULES])
    kind = (
        F.when(prose, "prose").when(c("n_words") == 0, "junk")
        .when((c("cell_line_share") >= 0.5) & (c("n_lines") >= 2) & (c("number_share") > 0.2), "table")
        .when((c("n_fields") >= 3) & (c("symbol_ratio") < 0.1), "fields")
        .when(c("bullet_line_share") >= 0.5, "list")
        .when((c("symbol_ratio") > 0.15) | (c("distinct_word_share") < 0.4) | (c("number_share") > 0.6), "junk")
        .when(c("n_lines") >= 3, "list").otherwise("junk")
    )
    reasons = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in failed.items()]), lambda r: r.isNotNull())
    return stats.withColumns({"reasons": reasons, "is_prose": prose, "kind": kind}).withColumn("passes", F.size("reasons") == 0)


def quality(df: DataFrame, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    return judged(statistics(df, text, keep))
