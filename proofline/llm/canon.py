"""One consistent form of text that looks the same (problem 3), and the looser keys built on it.

The work runs as embedded SQL: each Arrow batch of a Spark partition is handed to an in-process
DuckDB connection, which applies ``translate``, ``regexp_replace`` and ``nfc_normalize``.
No text leaves its partition.

Three forms are built:

``visual``  invisible characters removed, unusual spaces, line ends, compatibility forms and
            look-alike letters mapped, accents composed; case, punctuation, spacing and accents stay.
``loose``   ``visual`` in lower case, every run of other characters than letters, marks and digits
            replaced by one blank.
``key``     what is left when white space, case, punctuation and the order and notation of labelled
            fields are set aside (problem 4).

A null text has null forms; an empty text has empty forms.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: characters that show nothing, spaces of odd width, letters drawn alike ---------
INVISIBLE = "\u00AD\u061C\u180E\u200B\u200C\u200D\u200E\u200F\u202A\u202B\u202C\u202D\u202E\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\uFEFF"
ODD_SPACES = "\u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u202F\u205F\u3000"
LINE_ENDS = "\u0085\u2028\u2029"
LOOK_ALIKES = {
    # Cyrillic
    "\u0410": "A", "\u0412": "B", "\u0415": "E", "\u041A": "K", "\u041C": "M", "\u041D": "H", "\u041E": "O", "\u0420": "P", "\u0421": "C", "\u0422": "T", "\u0423": "Y",
    "\u0425": "X", "\u0405": "S", "\u0406": "I", "\u0408": "J", "\u0500": "D", "\u050C": "G", "\u051A": "Q", "\u051C": "W", "\u0474": "V", "\u04AE": "Y", "\u04BA": "H", "\u04C0": "I",
    "\u0430": "a", "\u0435": "e", "\u043E": "o", "\u0440": "p", "\u0441": "c", "\u0443": "y", "\u0445": "x", "\u0455": "s", "\u0456": "i", "\u0458": "j", "\u0501": "d",
    "\u04BB": "h", "\u051B": "q", "\u051D": "w", "\u0475": "v", "\u04AF": "y", "\u04CF": "l",
    # Greek
    "\u0391": "A", "\u0392": "B", "\u0395": "E", "\u0396": "Z", "\u0397": "H", "\u0399": "I", "\u039A": "K", "\u039C": "M", "\u039D": "N", "\u039F": "O", "\u03A1": "P",
    "\u03A4": "T", "\u03A5": "Y", "\u03A7": "X", "\u03BD": "v", "\u03BF": "o", "\u03C1": "p", "\u03C4": "t", "\u03C5": "u", "\u03BA": "k", "\u03B1": "a", "\u03B5": "e", "\u03B9": "i",
    # Latin and others
    "\u0251": "a", "\u0261": "g", "\u13AA": "A", "\u13B3": "W", "\u13DA": "S", "\u2010": "-", "\u2011": "-",
}
# ---------------------------------------------------------------------------------------------------

EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{FE0F}]"


@lru_cache(maxsize=1)
def single_map() -> dict[str, str]:
    """One character to one: look-alikes with and without accents, spaces, line ends, and the compatibility
    forms that draw the same letter (wide, narrow and font variants), taken by rule from the Unicode data."""
    table = {c: " " for c in ODD_SPACES} | {c: "\n" for c in LINE_ENDS} | dict(LOOK_ALIKES)
    for cp in (*range(0x0370, 0x0530), *range(0x1F00, 0x2000)):  # accented letters of the two scripts
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and parts[0] in LOOK_ALIKES:
            whole = unicodedata.normalize("NFC", LOOK_ALIKES[parts[0]] + parts[1:])
            if len(whole) == 1:
                table.setdefault(chr(cp), whole)
    for cp in (*range(0x2100, 0x2150), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800)):
        how = unicodedata.decomposition(chr(cp)).partition(">")[0]
        if how in ("<wide", "<narrow", "<font"):
            whole = unicodedata.normalize("NFKC", chr(cp))
            if len(whole) == 1:
                table[chr(cp)] = LOOK_ALIKES.get(whole, whole)
    return table


@lru_cache(maxsize=1)
def multi_map() -> dict[str, str]:
    """One character to several that look the same: the Latin ligatures and digraphs, by rule."""
    out = {"\u2026": "..."}
    for cp in (*range(0xFB00, 0xFB07), *range(0x01C4, 0x01CD), *range(0x01F1, 0x01F4), 0x0132, 0x0133):
        out[chr(cp)] = unicodedata.normalize("NFKC", chr(cp)).replace("\u017F", "f")
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(chars) -> str:
    return "[" + "".join(f"\\x{{{ord(c):04X}}}" for c in chars) + "]"


@lru_cache(maxsize=1)
def visual_sql() -> str:
    """SQL expression of the visual form of column ``text``. The costly steps run only on texts that hold a
    character they change: most texts hold none."""
    singles = {k: v for k, v in single_map().items() if ord(k) < 0x1D400}
    fonts = {k: v for k, v in single_map().items() if ord(k) >= 0x1D400}
    table = lambda m: f"{_quoted(''.join(m))}, {_quoted(''.join(m.values()))}"
    when = lambda test, then, e: f"CASE WHEN {test} THEN {then} ELSE {e} END"
    e = when("contains(text, chr(13))", r"regexp_replace(text, '\r\n?', chr(10), 'g')", "text")
    # the joiner inside an emoji shows; it is set aside while joiners elsewhere are removed
    joined = f"'({EMOJI})\\x{{200D}}({EMOJI})', '\\1' || chr(57344) || '\\2', 'g'"
    e = when("contains(text, chr(8205))", f"regexp_replace(regexp_replace({e}, {joined}), {joined})", e)
    e = when(f"regexp_matches(text, '{_class(INVISIBLE)}')", f"replace(regexp_replace({e}, '{_class(INVISIBLE)}', '', 'g'), chr(57344), chr(8205))", e)
    e = when(f"regexp_matches(text, '{_class(singles)}')", f"translate({e}, {table(singles)})", e)
    e = when("regexp_matches(text, '[\\x{1D400}-\\x{1D7FF}]')", f"translate({e}, {table(fonts)})", e)
    several = e
    for k, v in multi_map().items():
        several = f"replace({several}, {_quoted(k)}, {_quoted(v)})"
    e = when(f"regexp_matches(text, '{_class(multi_map())}')", several, e)
    return when("strlen(text) <> length(text)", f"nfc_normalize({e})", when("contains(text, chr(13))", r"regexp_replace(text, '\r\n?', chr(10), 'g')", "text"))


# A labelled field begins with a name and a colon or equals sign, bare or in quotes. A text that begins with one
# and holds at least three is a card: its fields are compared as a set.
LABEL = r'"?([\p{L}_]+)"?[ \t]*[:=]'
LOOSE_SQL = r"trim(regexp_replace(lower(visual), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))"
# Blanks between words are dropped, so that broken words and joined ones compare equal; two numbers stay apart.
BARE_SQL = r"replace(regexp_replace(regexp_replace({0}, '(\p{{N}}) (\p{{N}})', '\1_\2', 'g'), '(\p{{N}}) (\p{{N}})', '\1_\2', 'g'), ' ', '')"
_CLEAN = r"trim(regexp_replace(f, '[^\p{L}\p{M}\p{N}\x1F]+', ' ', 'g'))"
FIELDS_SQL = f"""list_sort(list_filter(list_transform(
    string_split(regexp_replace(lower(visual), '{LABEL}', chr(30) || '\\1' || chr(31), 'g'), chr(30)),
    lambda f: {BARE_SQL.format(_CLEAN)}), lambda f: f <> ''))"""
KEY_SQL = f"""CASE WHEN regexp_matches(visual, '^[^\\p{{L}}\\p{{N}}]*{LABEL}') AND len(regexp_extract_all(visual, '{LABEL}')) >= 3
    THEN array_to_string({FIELDS_SQL}, chr(30)) ELSE {BARE_SQL.format("loose")} END"""


def form_query(columns: str) -> str:
    """The embedded SQL: ``columns`` may name visual, loose and key, and any column of the batch."""
    return f"""SELECT {columns} FROM (SELECT *, {KEY_SQL} AS key FROM (SELECT *, {LOOSE_SQL} AS loose FROM (
        SELECT *, {visual_sql()} AS visual FROM batch)))"""


def connection():
    """A DuckDB connection for one partition: one thread, bounded memory, nothing on disk."""
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '400MB'")
    con.execute("SET enable_progress_bar = false")
    return con


def run_sql(sql: str, after: Callable[[pa.Table], pa.Table] | None = None):
    """A function for mapInArrow: runs ``sql`` on each batch (named batch), then ``after`` on its result."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connection()
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):  # a bounded piece at a time
                    batch = pa.Table.from_batches([whole.slice(at, 2048)])
                    con.register("batch", batch)
                    out = con.sql(sql).to_arrow_table()
                    con.unregister("batch")
                    yield from (after(out) if after else out).to_batches()
        finally:
            con.close()

    return work


def forms(df: DataFrame, text: str, columns: dict[str, str], keep: list[str] = ()) -> DataFrame:
    """``df``'s columns ``keep`` and, for each entry of ``columns`` (name: SQL over visual, loose, key), a string
    column. ``text`` names the text column; other columns of ``df`` are not read. Rows with null text have nulls.
    """
    kept = list(keep)
    inner = df.select(*[F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(kept)], F.col(text).alias("text"))
    sql = form_query(", ".join([*(f"c{i}" for i in range(len(kept))), *(f"{e} AS f{i}" for i, e in enumerate(columns.values()))]))
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(inner.schema.fields[:-1])), *(f"f{i} string" for i in range(len(columns)))])
    out = inner.mapInArrow(run_sql(sql), schema)
    return out.toDF(*kept, *columns)


def canonical_text(df: DataFrame, text: str = "text", out: str = "canonical", keep: list[str] = ()) -> DataFrame:
    """Problem 3: the columns ``keep`` of ``df`` and the consistent form ``out`` of column ``text``."""
    return forms(df, text, {out: "visual"}, keep)
