"""Plain SQL for the queries of this subpackage that SQL states on whole tables; the others are tested against brute
force in ``tests/llm``."""

from __future__ import annotations

from . import quality
from .canon import INVISIBLE, form_query, multi_map, single_map

_CATEGORY = "lower(trim({0}))"

P5_FOUND = f"""
WITH have AS (
    SELECT 'demo_human' AS table_name, 'meta.domain' AS field_name, {_CATEGORY.format("meta.domain")} AS category, count(*) AS n FROM demo_human GROUP BY 3
    UNION ALL SELECT 'demo_human', 'meta.era', {_CATEGORY.format("meta.era")}, count(*) FROM demo_human GROUP BY 3
    UNION ALL SELECT 'demo_ai', 'meta.domain', {_CATEGORY.format("meta.domain")}, count(*) FROM demo_ai GROUP BY 3),
sizes AS (SELECT 'demo_human' AS table_name, count(*) AS n FROM demo_human UNION ALL SELECT 'demo_ai', count(*) FROM demo_ai)
SELECT t.table_name, t.field_name, t.category FROM sample_targets t JOIN sizes s ON s.table_name = t.table_name
LEFT JOIN have h ON h.table_name = t.table_name AND h.field_name = t.field_name AND h.category = {_CATEGORY.format("t.category")}
WHERE coalesce(h.n, 0) < greatest(t.target_share * t.sample_fraction * s.n, t.min_rows)
"""


_CORPUS = "SELECT doc_id, text FROM demo_human UNION ALL SELECT doc_id, text FROM demo_ai"
_LOOKED_AT = """SELECT 'human:' || doc_id AS rec, text FROM demo_human UNION ALL SELECT 'ai:' || doc_id, text FROM demo_ai
    UNION ALL SELECT 'reph:' || pair_id, rephrased FROM demo_evasion_pairs"""


def _formed(source: str, columns: str) -> str:
    return f"batch AS ({source}), f AS MATERIALIZED ({form_query(columns)})"


P3_FOUND = f"""WITH {_formed(_LOOKED_AT, "rec, text, sha256(visual) AS form")}
SELECT least(a.rec, b.rec) AS rec_a, greatest(a.rec, b.rec) AS rec_b FROM f a JOIN f b ON a.form = b.form AND a.rec < b.rec AND a.text <> b.text"""
P3_CLASSES = f"WITH {_formed(_LOOKED_AT, 'rec, sha256(visual) AS form, sha256(text) AS raw')} SELECT * FROM f WHERE form IS NOT NULL"
P3_CANONICAL = f"WITH {_formed(_LOOKED_AT, 'rec, visual AS canonical')} SELECT * FROM f"
_GROUPED = f"WITH {_formed(_CORPUS, 'doc_id, text, key')}, g AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY key) AS first_id FROM f WHERE key IS NOT NULL)"
P4_FOUND = f"{_GROUPED} SELECT first_id, doc_id FROM g WHERE first_id <> doc_id"
P4_REPRESENTATIVES = f"{_GROUPED}, n AS (SELECT first_id, count(*) AS copies FROM g GROUP BY 1) SELECT first_id, copies, text FROM n JOIN g USING (first_id) WHERE doc_id = first_id"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _words_of(own) -> str:
    return "(" + ", ".join(map(_quoted, own)) + ")"


def _p2() -> str:
    """The figures and rules of problem 2 as common table expressions ``q`` (figures) and ``j`` (verdicts)."""
    table = single_map()
    plain = f"translate(translate(text, {_quoted(''.join(table))}, {_quoted(''.join(table.values()))}), {_quoted(INVISIBLE)}, '')"
    for k, v in multi_map().items():
        plain = f"replace({plain}, {_quoted(k)}, {_quoted(v)})"
    held = lambda own: f"len(list_filter(w, lambda x: x IN {_words_of(own)}))"
    lines = lambda p: f"len(list_filter(ln, lambda x: regexp_matches(x, {_quoted(p)})))"
    return rf"""c AS ({_CORPUS}), p AS MATERIALIZED (SELECT doc_id, coalesce({plain}, '') AS t FROM c),
    s AS MATERIALIZED (SELECT *, list_filter(string_split_regex(lower(t), '[^\p{{L}}\p{{M}}\p{{N}}''’-]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '') AS ln FROM p),
    q AS (SELECT doc_id, length(t) AS n_chars, len(w) AS n_words, len(ln) AS n_lines, greatest({", ".join(held(own) for own in quality.STOP_WORDS.values())}) AS n_stop_words,
        length(array_to_string(w, '')) / nullif(len(w), 0)::DOUBLE AS mean_word_length, {held(quality.COMMON)} / nullif(len(w), 0)::DOUBLE AS common_word_share,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) / nullif(len(w), 0)::DOUBLE AS alphabetic_word_share,
        len(regexp_extract_all(t, '[#…]|\.\.\.')) / nullif(len(w), 0)::DOUBLE AS marks_per_word,
        {lines(r"^\s*(?:[-*+•‣▪]|[0-9]{1,3}[.)])\s+[^\s]")} / nullif(len(ln), 0)::DOUBLE AS bullet_line_share FROM s),
    j AS (SELECT *, n_words > 0 AND n_stop_words >= {quality.MIN_STOP_WORDS} AND mean_word_length BETWEEN {quality.MIN_MEAN_LENGTH} AND {quality.MAX_MEAN_LENGTH}
        AND alphabetic_word_share >= {quality.MIN_ALPHABETIC_WORDS} AND marks_per_word <= {quality.MAX_SYMBOLS_PER_WORD} AND bullet_line_share <= {quality.MAX_BULLET_LINES} AS is_prose FROM q)"""


P2_FOUND = f"WITH {_p2()} SELECT doc_id FROM j WHERE NOT coalesce(is_prose, false)"
_ROUND = ("mean_word_length", "common_word_share", "alphabetic_word_share", "marks_per_word", "bullet_line_share")
P2_FIGURES = f"WITH {_p2()} SELECT doc_id, n_chars, n_words, n_lines, n_stop_words, {', '.join(f'round({k}, 6) AS {k}' for k in _ROUND)}, coalesce(is_prose, false) AS is_prose FROM j"

P5_FLOORS = f"""WITH t AS (SELECT table_name, field_name, category FROM sample_targets),
a AS (SELECT 'demo_human' AS table_name, 'meta.domain' AS field_name, {_CATEGORY.format("meta.domain")} AS c, count(*) AS n FROM demo_human GROUP BY 3
    UNION ALL SELECT 'demo_human', 'meta.era', {_CATEGORY.format("meta.era")}, count(*) FROM demo_human GROUP BY 3
    UNION ALL SELECT 'demo_ai', 'meta.domain', {_CATEGORY.format("meta.domain")}, count(*) FROM demo_ai GROUP BY 3)
SELECT t.table_name, t.field_name, t.category, coalesce(a.n, 0) AS available, true AS floor_met FROM t
LEFT JOIN a ON a.table_name = t.table_name AND a.field_name = t.field_name AND a.c = {_CATEGORY.format("t.category")}"""
P6_KEPT = f"SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, 0::BIGINT AS n_torn FROM ({_CORPUS})"
P7_KEPT = "SELECT container, (SELECT count(*) FROM documents WHERE text <> '') AS n_docs, 0::BIGINT AS n_too_full, 0::BIGINT AS n_cut FROM containers"
P8_KEPT = "SELECT source, CAST(max_repeats AS BIGINT) AS max_repeats, 0::BIGINT AS n_over, 0::BIGINT AS n_repeated FROM mix_targets"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": P2_FOUND, "p2_figures": P2_FIGURES, "p3_found": P3_FOUND, "p3_canonical": P3_CANONICAL, "p3_classes": P3_CLASSES, "p4_found": P4_FOUND, "p4_representatives": P4_REPRESENTATIVES,
        "p5_found": P5_FOUND, "p5_floors": P5_FLOORS, "p6_kept": P6_KEPT, "p7_kept": P7_KEPT, "p8_kept": P8_KEPT,
    }
