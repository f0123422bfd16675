"""SQL of the registered queries, for an engine that is not Spark. Each states its operator anew; patterns are written
for an engine without look-around. Queries that plain SQL can't state have none and are tested by hand."""

from __future__ import annotations

from ..functions.features import NAMES as FEATURE_NAMES
from ..functions.lexicon import LEXICON
from ..functions.normalize import CONFUSABLES, INVISIBLE, ODD_SPACES

# white space, a word's characters, and what may follow or come before one
WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
W = r"\p{L}\p{N}_"
IN = r"[\p{L}\p{N}_''’-]"
LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
MARK = rf"^[{WS}]*(?:[-*+•][{WS}]|\p{{Nd}}+[.)][{WS}]|#{{1,6}}[{WS}]|>[{WS}])"
WORD = r"[A-Za-zÀ-ɏ]+(?:[''’][A-Za-zÀ-ɏ]+)*"
SHORT = "('mr','mrs','ms','dr','prof','rev','gen','col','lt','sgt','capt','sr','jr','mt','e.g','i.e')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{WORD}'), lambda w: replace(lower(w), '’', ''''))"


def n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{WORD}'))"


def count(x: str, needle: str) -> str:
    return f"((length({x}) - length(replace({x}, '{needle}', ''))) // {len(needle)})"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# blocks, pieces of a block, pieces merged after abbreviations and initials
_LINE = f"CASE WHEN {strip('l')} = '' THEN chr(2) WHEN regexp_matches(l, '{MARK}') THEN chr(2) || coalesce(nullif({strip(f'''regexp_replace({strip('l')}, '{MARK}', '')''')}, ''), {strip('l')}) ELSE {strip('l')} END"
BLOCKS = f"list_filter(list_transform(string_split(array_to_string(list_transform(string_split_regex(text, '{LINES}'), lambda l: {_LINE}), ' '), chr(2)), lambda b: {strip('b')}), lambda b: b <> '')"
_PIECES = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(b, '(\.\.)([{WS}]+)', '\1' || chr(3) || '\2', 'g'),
    '([.!?]["''”’)\]]?)[{WS}]+(["''“‘(\[A-Z0-9])', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda p: {strip("replace(p, chr(3), '')")}), lambda p: p <> '')"""
_LAST = "regexp_extract(x, '[^\\x02]*$')"
_OPEN = rf"""(lower(regexp_extract(regexp_replace({_LAST}, '[.!?"''”’)\]]+$', ''), '[^ ]*$')) IN {SHORT} OR regexp_full_match({_LAST}, '(?:[A-Z]\.[{WS}]*)+'))"""
TEXTS = f"""
bl AS (SELECT *, {BLOCKS} AS blocks FROM d),
pi AS (SELECT *, list_transform(blocks, lambda b: {_PIECES}) AS pieces FROM bl),
se AS (SELECT *, flatten(list_transform(list_filter(pieces, lambda p: len(p) > 0), lambda p: string_split(list_reduce(p, lambda x, y: CASE WHEN {_OPEN} THEN x || ' ' || y ELSE x || chr(2) || y END), chr(2)))) AS sents,
    {words("text")} AS tokens FROM pi),
le AS (SELECT *, list_filter(list_transform(sents, lambda s: {n_words("s")}), lambda n: n > 0) AS lengths, len(tokens) AS n_words FROM se)
"""
DOCS = "d AS (SELECT * FROM documents WHERE text IS NOT NULL)"
ALL = "d AS (SELECT * FROM documents)"


def texts(select: str, base: str = DOCS, more: str = "") -> str:
    return f"WITH {base}, {TEXTS}{',' + more if more else ''} {select}"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0"


MEAN = "CASE WHEN len(lengths) = 0 THEN 0.0 ELSE list_sum(lengths) / CAST(len(lengths) AS DOUBLE) END"
SD = "CASE WHEN len(lengths) < 2 THEN 0.0 ELSE list_aggregate(list_transform(lengths, lambda v: CAST(v AS DOUBLE)), 'stddev_samp') END"


def mattr(n: int, t: str = "tokens") -> str:
    return f"""CASE WHEN len({t}) = 0 THEN 0.0 WHEN len({t}) <= {n} THEN len(list_distinct({t})) / CAST(len({t}) AS DOUBLE)
    ELSE list_avg(list_transform(range(1, len({t}) - {n} + 2), lambda i: len(list_distinct({t}[i:i + {n - 1}])) / {n}.0::DOUBLE)) END"""


_FROM, _TO = ODD_SPACES + "".join(CONFUSABLES) + INVISIBLE, " " * len(ODD_SPACES) + "".join(CONFUSABLES.values())
_held = lambda chars: f"(length(text) - length(translate(text, {quoted(chars)}, '')))"
HOMO, INVIS, SPACES = _held("".join(CONFUSABLES)), _held(INVISIBLE), _held(ODD_SPACES)
RATE = f"coalesce(({HOMO} + {INVIS} + {SPACES}) / nullif(CAST(length(text) AS DOUBLE), 0), 0.0)"
SUSPICIOUS = f"({INVIS} > 0 OR ({HOMO} >= 3 AND {RATE} > 0.002))"

# phrases: word runs are fenced off, each phrase in turn is found as a whole run of fenced words and blanked out
_fence = lambda x: f"regexp_replace(chr(4) || {x} || chr(4), '([^{W}])', chr(4) || '\\1' || chr(4), 'g')"


def lexicon_chain() -> tuple[str, str, str]:
    """(select list of successive texts, hits, weight) over a column t0."""
    import re

    steps, hits, weights = [], [], []
    for k, phrase in enumerate(sorted(LEXICON, key=len, reverse=True)):
        fenced = "\x04" + re.sub(r"([^\w])", "\x04\\1\x04", phrase) + "\x04"
        literal = " || ".join("chr(4)" if c == "\x04" else quoted(c) for c in re.split("(\x04)", fenced) if c)
        steps.append(f"replace(t{k}, {literal}, chr(1)) AS t{k + 1}")
        n = f"((length(t{k}) - length(t{k + 1})) // {len(fenced) - 1})"
        hits.append(n)
        weights.append(f"{n} * {LEXICON[phrase]}::DOUBLE")
    return ", ".join(steps), " + ".join(hits), " + ".join(weights)


def lexicon_cte(source: str) -> str:
    steps, hits, weights = lexicon_chain()
    chain = [s for s in steps.split(", replace(")]
    chain = [chain[0], *("replace(" + s for s in chain[1:])]
    out = f"lx0 AS (SELECT *, {_fence('lower(text)')} AS t0 FROM {source})"
    for k, step in enumerate(chain):
        out += f", lx{k + 1} AS (SELECT *, {step} FROM lx{k})"
    return out + f", lx AS (SELECT *, {hits} AS n_hits, {weights} AS lexical FROM lx{len(chain)})"


NOT_ONLY = rf"len(regexp_extract_all(text, '(?is)(?:^|[^{W}])not only(?:[^{W}]|[^{W}].{{0,118}}?[^{W}])but also(?:$|[^{W}])'))"
FROM_TO = rf"len(regexp_extract_all(text, '(?i)(?:^|[^{W}])from [{W}]+(?: [{W}]+)? to [{W}]+(?: [{W}]+)?, '))"
BULLET = rf"len(regexp_extract_all(text, '(?m)^[{WS}]*[-*•][{WS}]*\*\*[^*]+\*\*[:,]'))"
NUMBERED = rf"len(regexp_extract_all(text, '(?m)^[{WS}]*\p{{Nd}}+\.[{WS}]*\*\*[^*]+\*\*[:,]'))"
HEADING = rf"len(regexp_extract_all(text, '(?m)^#{{1,4}}[{WS}]'))"
TRIADS = rf"len(regexp_extract_all(text, '(?i)(?:^|[^{W}])[{W}]{IN}*, [{W}]{IN}*(?: [{W}]{IN}*)?, and [{W}]{IN}*'))"

# stylometry
_lg = lambda x: f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({x}))))"
STYLE = f"""st0 AS (SELECT *, len(lengths) AS n_sentences, {MEAN} AS mean_s, {SD} AS sd_s, {mattr(50)} AS mattr,
    CASE WHEN n_words = 0 THEN 0.0 ELSE list_sum(list_transform(tokens, lambda w: length(w))) / CAST(n_words AS DOUBLE) END AS wl,
    CASE WHEN n_words = 0 THEN 0.0 ELSE ({count("text", "—")} + {count("text", " -- ")}) * 1000.0::DOUBLE / n_words END AS em FROM le),
st1 AS (SELECT *, CASE WHEN mean_s = 0 THEN 0.0 ELSE sd_s / mean_s END AS burst,
    CASE WHEN n_sentences = 0 THEN 0.0 ELSE len(list_filter(lengths, lambda v: v <= 4)) / CAST(n_sentences AS DOUBLE) END AS short,
    CASE WHEN n_sentences < 4 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS u FROM st0),
st AS (SELECT *, CASE WHEN n_words = 0 THEN 0.5::DOUBLE ELSE (u * 0.34::DOUBLE * {_lg("-(burst - 0.42) / 0.12")} + u * 0.16::DOUBLE * {_lg("-(short - 0.08) / 0.05")} + 0.14::DOUBLE * {_lg("-(mattr - 0.72) / 0.06")}
    + 0.16::DOUBLE * {_lg("(wl - 4.55) / 0.35")} + 0.20::DOUBLE * {_lg("(em - 2.0) / 1.2")}) / (u * 0.5::DOUBLE + 0.5::DOUBLE) END AS stylometry_score,
    n_words >= 50 AND n_sentences >= 4 AS stylometry_reliable FROM st1)"""
PHRASES = f"""ph0 AS (SELECT *, lexical + 2.0::DOUBLE * {NOT_ONLY} + 1.0::DOUBLE * {FROM_TO} + 1.5::DOUBLE * {BULLET} + 1.5::DOUBLE * {NUMBERED} + 0.5::DOUBLE * {HEADING} AS w0,
    {TRIADS} - 0.25::DOUBLE * greatest(1, len(sents)) AS over_t FROM lx),
ph1 AS (SELECT *, (w0 + CASE WHEN over_t > 30 THEN over_t ELSE ln(1 + exp(over_t)) END) * 1000.0::DOUBLE / nullif(n_words, 0) AS phrase_rate FROM ph0),
ph AS (SELECT *, CASE WHEN n_words = 0 THEN 0.5::DOUBLE ELSE 0.30::DOUBLE + 0.70::DOUBLE * (1.0::DOUBLE - exp(-phrase_rate / 18.0)) END AS phrases_score, n_words >= 50 AS phrases_reliable FROM ph1)"""
BOTH = f"{STYLE}, {lexicon_cte('st')}, {PHRASES}"

# metrics
SCORED = """s AS (SELECT DISTINCT doc_id, detector, run_no, label, score, source, domain, scored_at FROM scored),
u AS (SELECT * FROM s WHERE score IS NOT NULL AND label IN (0, 1))"""
CONF = """c AS (SELECT detector, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
    count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM u GROUP BY detector)"""
CLASS = """k0 AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy, coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0) AS fpr FROM c),
k AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM k0)"""
RANKS = """sc AS (SELECT detector, score, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos FROM u GROUP BY detector, score),
rk AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY detector ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rank FROM sc)"""
AUROC = """au AS (SELECT detector, (sum(rank * n_pos) - sum(n_pos) * (sum(n_pos) + 1) / 2.0) / nullif(sum(n_pos)::DOUBLE * sum(n - n_pos), 0) AS auroc FROM rk GROUP BY detector)"""
ROC = """ro AS (SELECT detector, score AS threshold, sum(n - n_pos) OVER w / nullif(sum(n - n_pos) OVER (PARTITION BY detector), 0)::DOUBLE AS fpr, sum(n_pos) OVER w / nullif(sum(n_pos) OVER (PARTITION BY detector), 0)::DOUBLE AS tpr
    FROM sc WINDOW w AS (PARTITION BY detector ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    UNION ALL SELECT DISTINCT detector, NULL, 0.0, 0.0 FROM u)"""
ECE = """eb AS (SELECT detector, least(greatest(CAST(trunc(score * 10) AS INT), 0), 9) AS b, count(*) AS n, avg(score) AS p, avg(label) AS a FROM u GROUP BY 1, 2),
ec AS (SELECT detector, sum(n * abs(p - a)) / sum(n) AS ece FROM eb GROUP BY detector)"""
CUT = """cu AS (SELECT detector, coalesce((list_sort(list(score), 'DESC'))[CAST(floor(count(*) * 0.05::DOUBLE) AS BIGINT) + 1], -1e308) AS cut FROM u WHERE label = 0 GROUP BY detector)"""


def groups(column: str, name: str = "g", source: str = "u") -> str:
    return f"""{name}0 AS (SELECT detector, coalesce({column}, 'unknown') AS grp, count(*) AS n, count(*) FILTER (score >= 0.5) AS n_flagged FROM {source} WHERE label = 0 GROUP BY 1, 2),
{name}1 AS (SELECT *, n_flagged / n::DOUBLE AS fpr FROM {name}0),
{name} AS (SELECT *, greatest(0.0, (fpr + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(fpr * (1 - fpr) / n + 3.8416::DOUBLE / (4.0 * n * n))) / (1 + 3.8416::DOUBLE / n)) AS low,
    least(1.0, (fpr + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(fpr * (1 - fpr) / n + 3.8416::DOUBLE / (4.0 * n * n))) / (1 + 3.8416::DOUBLE / n)) AS high FROM {name}1)"""


WIDE = "w AS (SELECT doc_id, run_no, max(score) FILTER (detector = 'ensemble') AS ensemble, max(score) FILTER (detector = 'supervised') AS supervised, max(score) FILTER (detector = 'phrases') AS phrases, max(score) FILTER (detector = 'stylometry') AS stylometry FROM u GROUP BY doc_id, run_no)"
_DET = (("ensemble", 1.0), ("phrases", 1.0), ("stylometry", 1.0), ("supervised", 1.0))


def wmean(weights: dict[str, float]) -> str:
    top = " + ".join(f"coalesce({n}, 0) * {w}::DOUBLE" for n, w in weights.items())
    bottom = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE {w}::DOUBLE END" for n, w in weights.items())
    return f"CASE WHEN ({bottom}) = 0 THEN 0.5::DOUBLE ELSE ({top}) / ({bottom}) END"


def band(score: str, ok: str) -> str:
    return f"""CASE WHEN NOT ({ok}) THEN 'insufficient evidence (text too short for any detector to be reliable)' WHEN {score} >= 0.8::DOUBLE THEN 'likely AI-generated' WHEN {score} >= 0.6::DOUBLE THEN 'leaning AI-generated'
    WHEN {score} >= 0.4::DOUBLE THEN 'uncertain' WHEN {score} >= 0.2::DOUBLE THEN 'leaning human-written' ELSE 'likely human-written' END"""


STATUS = "CASE source WHEN 'model_outputs_a' THEN 'verified_ai' WHEN 'model_outputs_b' THEN 'invalid' WHEN 'lab_notes' THEN 'verified_human_claim' WHEN 'open_forum' THEN 'absent' END"

# calibration
BIN = "len(list_filter(bin_edges, lambda e: n_words >= e))"
THRESHOLD = f"CASE WHEN isfinite(coalesce(bin_thresholds[{BIN}], 'infinity'::DOUBLE)) THEN bin_thresholds[{BIN}] ELSE global_threshold END"


def order_stat(keys: str, source: str, alpha: float) -> str:
    return f"SELECT {keys}, count(*) AS n, (list_sort(list(score)))[CAST(ceil((count(*) + 1) * {1.0 - alpha!r}::DOUBLE) AS BIGINT)] AS threshold FROM {source} GROUP BY {keys}"


CAL = f"""hc AS (SELECT *, len(list_filter([50, 100, 250, 500], lambda e: n_words >= e)) AS bin FROM human_calib WHERE score IS NOT NULL),
hg AS ({order_stat("language", "hc", 0.05)}), hb AS ({order_stat("language, bin", "hc", 0.05)})"""
JOINED = "j AS (SELECT h.*, c.language IS NOT NULL AS calibrated, c.alpha, c.global_threshold, c.bin_edges, c.bin_thresholds FROM human_calib h LEFT JOIN calibration c ON c.language = h.language)"

# pairs
PAIRED = f"""d AS (SELECT pair_id, 0 AS k, original AS text FROM demo_evasion_pairs WHERE original IS NOT NULL UNION ALL SELECT pair_id, 1, rephrased FROM demo_evasion_pairs WHERE rephrased IS NOT NULL), {TEXTS}, {BOTH},
ea AS (SELECT pair_id, k, unnest([{{'detector': 'stylometry', 'score': stylometry_score}}, {{'detector': 'phrases', 'score': phrases_score}}, {{'detector': 'ensemble', 'score': (stylometry_score + phrases_score) / 2}}]) AS x FROM ph),
pr AS (SELECT pair_id, x.detector AS detector, max(x.score) FILTER (k = 0) AS score_original, max(x.score) FILTER (k = 1) AS score_rephrased FROM ea GROUP BY 1, 2)"""

STAND_IN = f"si AS (SELECT doc_id, list_transform(sents, lambda s: {n_words('s')}) AS nw, list_transform(sents, lambda s: least(1.0::DOUBLE, {n_words('s')} / 37.0::DOUBLE)) AS sc FROM se)"

AI_SHARE = "coalesce(list_sum(list_transform(range(1, len(sc) + 1), lambda i: CASE WHEN sc[i] >= 0.5 THEN nw[i] ELSE 0 END)) / nullif(list_sum(nw), 0)::DOUBLE, 0)"

# windows of sentences: each is the shortest of 120 words from its start, the next one starts 60 words later
_FROM_ON = "list_min(list_filter(range({0}, n + 1), lambda e: up[e + 1] - up[{0} + 1] >= {1}))"
_END = "coalesce(" + _FROM_ON.format("{0}", 120) + ", n)"
_NEXT = "greatest(least(coalesce(" + _FROM_ON.format("w.a", 60) + ", n - 1), n - 1), w.a + 1)"
WINDOWS = f"""{STAND_IN}, sn AS (SELECT doc_id, nw, len(nw) AS n, list_transform(range(0, len(nw) + 1), lambda i: coalesce(list_sum(nw[1:i]), 0)) AS up FROM si WHERE len(nw) > 0),
w AS (SELECT doc_id, 0::BIGINT AS pos, 0::BIGINT AS a, CAST({_END.format("0")} AS BIGINT) AS b FROM sn
    UNION ALL SELECT doc_id, pos + 1, nx, CAST({_END.format("nx")} AS BIGINT) FROM (SELECT w.doc_id, w.pos, sn.n, sn.up, CAST({_NEXT} AS BIGINT) AS nx FROM w JOIN sn USING (doc_id) WHERE w.b < sn.n))"""
SPANNED = f"WITH RECURSIVE {DOCS}, {TEXTS}, {WINDOWS}"

# hits per phrase
HITS = "list_filter([" + ", ".join(f"{{{{'phrase': {quoted(p)}, 'n': h{k}, 'weight': {LEXICON[p]}::DOUBLE}}}}" for k, p in enumerate(sorted(LEXICON, key=len, reverse=True))) + "], lambda h: h.n > 0)"


def hits_cte(source: str) -> str:
    """(source's columns, held: list of phrase, n, weight)."""
    counted = ", ".join(f"{h} AS h{k}" for k, h in enumerate(lexicon_chain()[1].split(" + ")))
    return f"{lexicon_cte(source)}, hi AS (SELECT *, {HITS.replace('{{', '{').replace('}}', '}')} AS held FROM (SELECT *, {counted} FROM lx))"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    corpus = "SELECT doc_id, text, label, source FROM demo_human UNION ALL SELECT doc_id, text, label, source FROM demo_ai"
    q["src_demo"] = q["union_corpus"] = f"SELECT doc_id, text, CAST(label AS BIGINT) AS label, source FROM ({corpus})"
    q["src_labeled_jsonl"] = "SELECT CAST(label AS BIGINT) AS label, coalesce(source, 'unknown') AS source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM demo_human GROUP BY 1, 2"
    q["src_pairs_jsonl"] = "SELECT count(*) AS n, CAST(sum(length(original)) AS BIGINT) AS n_original, CAST(sum(length(rephrased)) AS BIGINT) AS n_rephrased FROM demo_evasion_pairs"
    q["src_calibration"] = f"SELECT language, {r6('alpha')} AS alpha, n_calibration, {r6('global_threshold')} AS global_threshold, CAST(len(bin_edges) AS BIGINT) AS n_edges, CAST(len(map_keys(bin_thresholds)) AS BIGINT) AS n_bins FROM calibration"

    q["norm_text"] = f"SELECT doc_id, translate(text, {quoted(_FROM)}, {quoted(_TO)}) AS mapped FROM documents"
    q["norm_counts"] = f"SELECT doc_id, {HOMO} AS homoglyphs_replaced, {INVIS} AS invisibles_removed, {SPACES} AS odd_spaces_replaced, length(text) AS n_chars FROM documents"
    q["norm_tamper_rate"] = f"SELECT doc_id, {r6(RATE)} AS tamper_rate FROM documents"
    q["norm_suspicious"] = f"SELECT lang, count(*) FILTER ({SUSPICIOUS}) AS n_suspicious, count(*) AS n FROM documents GROUP BY lang"

    q["words"] = f"SELECT doc_id, array_to_string({words('text')}, ' ') AS tokens, {n_words('text')} AS n_words FROM documents"
    q["blocks"] = f"WITH {ALL}, {TEXTS} SELECT doc_id, array_to_string(blocks, ' | ') AS blocks FROM bl"
    q["sentences"] = texts("SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(sents, ' | '), '') END AS sentences FROM se", ALL)
    q["sentence_lengths"] = texts("SELECT doc_id, array_to_string(lengths, ' ') AS lengths FROM le")
    q["mean_stdev_cv"] = texts(f"SELECT doc_id, {r6(MEAN)} AS mean, {r6(SD)} AS sd, {r6(f'CASE WHEN ({MEAN}) = 0 THEN 0 ELSE ({SD}) / ({MEAN}) END')} AS cv FROM le")
    q["mattr"] = f"WITH t AS (SELECT doc_id, {words('text')} AS tokens FROM documents WHERE text IS NOT NULL) SELECT doc_id, {r6(mattr(50))} AS mattr FROM t"
    q["mattr_window"] = f"WITH t AS (SELECT doc_id, {words('text')} AS tokens FROM documents WHERE text IS NOT NULL) SELECT doc_id, {r6(mattr(7))} AS mattr_7, {r6(mattr(21))} AS mattr_21 FROM t"
    q["logistic"] = f"WITH {SCORED} SELECT doc_id, detector, CAST(run_no AS BIGINT) AS run_no, {r6('1 / (1 + exp(-(score - 0.5::DOUBLE) * 8))')} AS p FROM u"
    q["softplus"] = f"WITH {SCORED}, v AS (SELECT *, (score - 0.5::DOUBLE) * 100 AS x FROM u) SELECT doc_id, detector, CAST(run_no AS BIGINT) AS run_no, {r6('CASE WHEN x > 30 THEN x ELSE ln(1 + exp(x)) END')} AS s FROM v"

    per = lambda x: f"{r6(f'CASE WHEN n_words > 0 THEN ({x}) * 1000.0::DOUBLE / n_words END')}"
    some = lambda x: f"{r6(f'CASE WHEN n_words > 0 THEN ({x}) END')}"
    kept = lambda cond: f"len(list_filter(tokens, lambda w: {cond}))"
    q["feature_vector"] = texts(
        f"""SELECT doc_id, n_words, {some(f'CASE WHEN ({MEAN}) = 0 THEN 0 ELSE ({SD}) / ({MEAN}) END')} AS burstiness, {some(MEAN)} AS mean_sentence_len, {some(SD)} AS sd_sentence_len,
        {some("len(list_filter(lengths, lambda v: v <= 4)) / greatest(1, len(lengths))::DOUBLE")} AS short_sentence_rate, {some("len(list_filter(lengths, lambda v: v >= 30)) / greatest(1, len(lengths))::DOUBLE")} AS long_sentence_rate,
        {some(mattr(50))} AS mattr, {some("list_avg(list_transform(tokens, lambda w: length(w)))")} AS mean_word_len,
        {some("CASE WHEN n_words < 2 THEN 0 ELSE list_aggregate(list_transform(tokens, lambda w: CAST(length(w) AS DOUBLE)), 'stddev_samp') END")} AS sd_word_len,
        {some(kept("length(w) >= 8") + " / n_words::DOUBLE")} AS long_word_rate, {per(count("text", "—") + " + " + count("text", " -- "))} AS em_dash_per_kw,
        {per(count("text", ";"))} AS semicolon_per_kw, {per(count("text", ":"))} AS colon_per_kw, {per(count("text", ","))} AS comma_per_kw, {per(count("text", "?"))} AS question_per_kw,
        {per(count("text", "!"))} AS exclaim_per_kw, {per(count("text", '"') + " + " + count("text", "“"))} AS quote_per_kw, {per(count("text", "("))} AS paren_per_kw,
        {some("len(regexp_extract_all(text, '[" + chr(92) + "p{Nd}²³¹⁰-⁹₀-₉①-⑨]')) / greatest(1, length(text))::DOUBLE")} AS digit_rate,
        {some("len(regexp_extract_all(text, '" + chr(92) + "p{Lu}')) / greatest(1, length(text))::DOUBLE")} AS uppercase_rate, {per(kept("contains(w, '''')"))} AS contraction_per_kw,
        {per(kept("w IN ('i', 'i''m', 'i''ve', 'my', 'me')"))} AS first_person_per_kw, {per(kept("w IN ('maybe', 'probably', 'roughly', 'sort', 'kind', 'seems', 'guess')"))} AS hedge_per_kw,
        {some("ln(1 + n_words)")} AS log_n_words FROM le"""
    )
    q["det_stylometry"] = texts(f"SELECT doc_id, {r6('stylometry_score')} AS stylometry_score, stylometry_reliable, n_sentences, {r6('burst')} AS burstiness, {r6('mattr')} AS mattr FROM st", DOCS, STYLE)
    q["lex_hits"] = f"WITH {DOCS}, {lexicon_cte('d')} SELECT doc_id, n_hits, {r6('lexical')} AS weight FROM lx"
    q["structural_hits"] = f"SELECT doc_id, {NOT_ONLY} AS not_only_but_also, {FROM_TO} AS from_x_to_y_frame, {BULLET} AS bullet_with_bold_lead, {NUMBERED} AS numbered_bold_lead, {HEADING} AS colon_triad_header FROM documents"
    q["triads"] = f"SELECT doc_id, {TRIADS} AS triads FROM documents"
    q["det_phrases"] = texts(f"SELECT doc_id, {r6('phrases_score')} AS phrases_score, phrases_reliable, {r6('phrase_rate')} AS phrase_rate FROM ph", DOCS, f"{lexicon_cte('le')}, {PHRASES}")
    two = wmean({"stylometry_score": 1.0, "phrases_score": 1.0})
    ok = "(n_words >= 50 AND (stylometry_reliable OR phrases_reliable))"
    q["ens_reliable"] = texts(f"SELECT doc_id, {ok} AS is_reliable FROM ph", DOCS, BOTH)
    q["verdict_bands"] = texts(f"SELECT lang, {band(two, ok)} AS band, count(*) AS n, {r6(f'avg({two})')} AS mean_score FROM ph GROUP BY 1, 2", DOCS, BOTH)

    wide = f"WITH {SCORED}, {WIDE} SELECT doc_id, CAST(run_no AS BIGINT) AS run_no, "
    q["ens_weighted"] = wide + f"{r6(wmean(dict(_DET)))} AS preset, {r6(wmean({n: 1.0 for n, _ in _DET}))} AS plain, {r6(wmean({n: 0.0 for n, _ in _DET}))} AS zero FROM w"
    q["verdict_band"] = wide + f"{band('coalesce(stylometry, 0.5::DOUBLE)', 'stylometry IS NOT NULL')} AS band FROM w"
    pair = wmean({"phrases": 1.0, "stylometry": 1.0})
    q["blend"] = wide + f"{r6(f'CASE WHEN supervised IS NULL THEN {pair} ELSE 0.6::DOUBLE * supervised + 0.4::DOUBLE * ({pair}) END')} AS blended, supervised IS NOT NULL AS primary_usable FROM w"
    gap = "CASE WHEN supervised IS NULL THEN 0.0::DOUBLE ELSE abs(supervised - (coalesce(phrases, 0.5::DOUBLE) + coalesce(stylometry, 0.5::DOUBLE)) / 2) END"
    q["ood_flag"] = wide + f"{r6(gap)} AS gap, {gap} >= 0.45::DOUBLE AS is_ood FROM w"
    q["provenance_combine"] = f"""WITH {SCORED}, sg AS (SELECT doc_id, {STATUS} AS status FROM documents) SELECT u.doc_id, detector, CAST(run_no AS BIGINT) AS run_no, status, {r6("CASE status WHEN 'verified_ai' THEN greatest(score, 0.99::DOUBLE) WHEN 'invalid' THEN greatest(score, least(1.0::DOUBLE, score + 0.10::DOUBLE)) ELSE score END")} AS combined
        FROM u LEFT JOIN sg USING (doc_id)"""
    q["provenance_flags"] = f"SELECT doc_id, coalesce({STATUS} = 'verified_ai', false) AS is_ai_evidence, coalesce({STATUS} IN ('verified_ai', 'invalid'), false) AS is_informative FROM documents"

    q["filter_label"] = f"WITH {SCORED} SELECT detector, domain, count(*) AS n FROM u WHERE label = 0 GROUP BY 1, 2"
    q["validate"] = f"""WITH {SCORED}, v AS (SELECT detector, count(*) AS n, count(*) FILTER (label = 0) AS n_human, count(*) FILTER (label = 1) AS n_ai, count(*) FILTER (label IS NULL OR label NOT IN (0, 1) OR score IS NULL) AS n_unusable FROM s GROUP BY detector)
        SELECT *, n_human > 0 AND n_ai > 0 AND n_unusable = 0 AS valid FROM v"""
    q["confusion"] = f"WITH {SCORED}, {CONF} SELECT * FROM c"
    figures = ", ".join(f"{r6(k)} AS {k}" for k in ("precision", "recall", "accuracy", "fpr", "f1"))
    q["classification"] = f"WITH {SCORED}, {CONF}, {CLASS} SELECT detector, tp, fp, tn, fn, {figures} FROM k"
    q["brier"] = f"WITH {SCORED} SELECT detector, {r6('avg((score - label) * (score - label))')} AS brier FROM u GROUP BY 1"
    q["ece"] = f"WITH {SCORED}, {ECE} SELECT detector, {r6('ece')} AS ece FROM ec"
    q["avg_ranks"] = f"WITH {SCORED}, {RANKS} SELECT detector, {r6('score')} AS score, n, n_pos, {r6('rank')} AS rank FROM rk"
    q["auroc"] = f"WITH {SCORED}, {RANKS}, {AUROC} SELECT detector, {r6('auroc')} AS auroc FROM au"
    q["roc_points"] = f"WITH {SCORED}, {RANKS}, {ROC} SELECT detector, {r6('threshold')} AS threshold, {r6('fpr')} AS fpr, {r6('tpr')} AS tpr FROM ro"
    best = lambda b: f"SELECT detector, max(tpr) AS tpr FROM ro WHERE fpr <= {b}::DOUBLE GROUP BY detector"
    q["tpr_at_fpr"] = f"WITH {SCORED}, {RANKS}, {ROC}, b AS ({best(0.05)}) SELECT b.detector, {r6('b.tpr')} AS tpr, {r6('max(CASE WHEN b.tpr = 0 THEN NULL ELSE threshold END)')} AS threshold FROM b JOIN ro ON ro.detector = b.detector AND ro.tpr = b.tpr AND ro.fpr <= 0.05::DOUBLE GROUP BY b.detector, b.tpr"
    q["threshold_at_fpr"] = f"WITH {SCORED}, {CUT} SELECT detector, {r6('cut')} AS cut FROM cu"
    q["domain_adjusted_tpr"] = f"WITH {SCORED}, {CUT}, pd AS (SELECT detector, domain, avg(CASE WHEN score > cut THEN 1.0::DOUBLE ELSE 0 END) AS t FROM u JOIN cu USING (detector) WHERE label = 1 GROUP BY 1, 2) SELECT detector, {r6('avg(t)')} AS macro_tpr, count(*) AS n_domains FROM pd GROUP BY 1"
    full = f"SELECT detector, grp, n, n_flagged, {r6('fpr')} AS fpr, {r6('low')} AS low, {r6('high')} AS high"
    q["subgroup_fpr"] = f"WITH {SCORED}, {groups('domain')} {full} FROM g"
    q["wilson"] = f"WITH {SCORED}, {groups('source')} SELECT detector, grp, {r6('low')} AS low, {r6('high')} AS high FROM g"
    q["order_groups"] = f"WITH {SCORED}, {groups('domain')} SELECT detector, grp, n FROM g ORDER BY detector, grp"
    q["max_subgroup_gap"] = f"WITH {SCORED}, {groups('domain')} SELECT detector, {r6('CASE WHEN count(*) >= 2 THEN max(fpr) - min(fpr) ELSE 0 END')} AS gap FROM g GROUP BY 1"
    q["fairness"] = f"WITH {SCORED}, e AS (SELECT u.*, lower(trim(h.meta.era)) AS era FROM u JOIN demo_human h USING (doc_id) WHERE u.label = 0), {groups('era', 'g', 'e')} {full}, fpr > 0.05::DOUBLE AS over_cap FROM g"
    q["fpr_resolution"] = f"WITH {SCORED}, v AS (SELECT detector, count(*) FILTER (label = 0) AS n_neg FROM u GROUP BY 1) SELECT detector, n_neg, {r6('1.0::DOUBLE / n_neg')} AS resolution, 1.0::DOUBLE / n_neg <= 0.05 AS measurable_5, 1.0::DOUBLE / n_neg <= 0.01 AS measurable_1 FROM v"
    q["evaluate_scores"] = f"""WITH {SCORED}, {CONF}, {CLASS}, {RANKS}, {AUROC}, {ROC}, {ECE}, br AS (SELECT detector, avg((score - label) * (score - label)) AS brier, count(*) FILTER (label = 0) AS n_neg FROM u GROUP BY 1), b5 AS ({best(0.05)}), b1 AS ({best(0.01)})
        SELECT k.detector, tp, fp, tn, fn, {figures}, {r6('brier')} AS brier, {r6('ece')} AS ece, {r6('auroc')} AS auroc, {r6('b5.tpr')} AS tpr_5, {r6('b1.tpr')} AS tpr_1, {r6('1.0::DOUBLE / n_neg')} AS resolution
        FROM k JOIN br USING (detector) JOIN ec USING (detector) JOIN au USING (detector) JOIN b5 USING (detector) JOIN b1 USING (detector)"""
    q["distinct_sources"] = f"WITH {SCORED} SELECT detector, count(DISTINCT label) AS n_classes, count(DISTINCT source) AS n_sources FROM u GROUP BY 1"
    q["join_corr_scores"] = f"WITH {SCORED} SELECT doc_id, CAST(run_no AS BIGINT) AS run_no, detector, {r6('max(score)')} AS score FROM u GROUP BY 1, 2, 3"
    q["join_positional"] = f"WITH {SCORED} SELECT CAST(a.run_no AS BIGINT) AS run_no, count(*) AS n, {r6('avg(a.score - b.score)')} AS mean_gap FROM u a JOIN u b USING (doc_id, run_no) WHERE a.detector = 'stylometry' AND b.detector = 'phrases' GROUP BY 1"

    q["conformal_threshold"] = f"WITH {CAL} SELECT language, n, {r6('threshold')} AS threshold FROM hg"
    q["min_calibration_size"] = "SELECT language, CAST(greatest(1, ceil(1.0::DOUBLE / alpha) - 1) AS BIGINT) AS least FROM calibration"
    q["calibrate"] = f"WITH {CAL} SELECT hb.language, hg.n AS n_calibration, CAST(bin AS BIGINT) AS bin, {r6('CASE WHEN hb.n >= 20 THEN hb.threshold END')} AS threshold, hb.n AS n FROM hb JOIN hg ON hg.language IS NOT DISTINCT FROM hb.language"
    q["join_calibration"] = f"WITH {JOINED} SELECT language, calibrated, {r6('alpha')} AS alpha, count(*) AS n FROM j GROUP BY language, calibrated, alpha"
    q["join_bin_lookup"] = f"WITH {JOINED} SELECT calib_id, {BIN} AS bin FROM j WHERE calibrated"
    q["threshold_for"] = f"WITH {JOINED} SELECT calib_id, {r6(THRESHOLD)} AS threshold FROM j"
    q["flagged"] = f"WITH {JOINED} SELECT calib_id, coalesce(score >= {THRESHOLD}, false) AS flagged FROM j"
    q["certified"] = "SELECT language, coalesce(isfinite(global_threshold), false) AS certified, CAST(greatest(0, ceil(1.0::DOUBLE / alpha) - 1 - n_calibration) AS BIGINT) AS shortfall FROM calibration"
    q["empirical_fpr"] = f"WITH {JOINED}, f AS (SELECT language, coalesce(score >= {THRESHOLD}, false) AS flagged FROM j WHERE calibrated AND score IS NOT NULL) SELECT language, count(*) AS n, count(*) FILTER (flagged) AS n_flagged, {r6('avg(CASE WHEN flagged THEN 1.0::DOUBLE ELSE 0 END)')} AS fpr FROM f GROUP BY 1"
    q["upsert_calibration"] = f"SELECT language, {r6('alpha')} AS alpha, n_calibration FROM calibration WHERE language <> 'en' UNION ALL SELECT 'en', 0.05, count(*) FROM human_calib WHERE language = 'en' AND score IS NOT NULL"

    q["join_pairs"] = f"WITH {PAIRED} SELECT pair_id, detector, {r6('score_original')} AS score_original, {r6('score_rephrased')} AS score_rephrased FROM pr"
    q["evasion_report"] = f"""WITH {PAIRED}, p AS (SELECT * FROM pr WHERE score_original IS NOT NULL AND score_rephrased IS NOT NULL), g AS (SELECT detector, count(*) AS n_pairs, avg(score_original) AS a, avg(score_rephrased) AS b, avg(score_original - score_rephrased) AS c,
        count(*) FILTER (score_original >= 0.5) AS flagged, count(*) FILTER (score_original >= 0.5 AND score_rephrased < 0.5) AS evaded FROM p GROUP BY detector)
        SELECT detector, n_pairs, {r6('a')} AS mean_original, {r6('b')} AS mean_rephrased, {r6('c')} AS mean_delta, flagged, evaded, {r6('evaded / nullif(flagged, 0)::DOUBLE')} AS evasion_rate FROM g"""
    q["compare_pair"] = f"WITH {PAIRED} SELECT pair_id, detector, {r6('score_original - score_rephrased')} AS delta, CASE WHEN score_original >= 0.5 AND score_rephrased < 0.5 THEN 'evaded' WHEN score_rephrased >= 0.5 THEN 'still flagged' ELSE 'never flagged' END AS outcome FROM pr"

    q["change_point"] = texts(
        f"""SELECT si.doc_id, cut, {r6('delta')} AS delta, abs(delta) >= 0.25::DOUBLE AS is_significant FROM si LEFT JOIN best ON best.doc_id = si.doc_id AND rn = 1""", DOCS,
        f"""{STAND_IN}, cuts AS (SELECT doc_id, sc, unnest(range(2, len(sc) - 1)) AS cut FROM si WHERE len(sc) >= 4),
        halves AS (SELECT doc_id, cut, len(sc) AS n, list_sum(sc[1:cut]) / cut AS b, list_sum(sc[cut + 1:]) / (len(sc) - cut) AS a FROM cuts),
        best AS (SELECT doc_id, cut, a - b AS delta, row_number() OVER (PARTITION BY doc_id ORDER BY round(abs(a - b) * sqrt(cut * (n - cut) / n::DOUBLE), 12) DESC, cut) AS rn FROM halves)""",
    )
    q["ai_word_fraction"] = texts(f"SELECT doc_id, {r6(AI_SHARE)} AS fraction FROM si", DOCS, STAND_IN)

    reasons = f"""list_filter([CASE WHEN n_words < 100 THEN 'text_too_short' END, CASE WHEN {SUSPICIOUS} THEN 'unicode_tampering_detected' END, CASE WHEN NOT calibrated THEN 'no_calibration_for_language' END,
        CASE WHEN calibrated AND NOT coalesce(isfinite(global_threshold), false) THEN 'calibration_too_small_for_fpr_cap' END], lambda r: r IS NOT NULL)"""
    q["decide"] = texts(
        f"""SELECT doc_id, CASE WHEN status = 'verified_ai' THEN 'ai' WHEN len(why) > 0 THEN 'abstain' WHEN share BETWEEN 0.15::DOUBLE AND 0.85::DOUBLE THEN 'mixed' WHEN stylometry_score >= {THRESHOLD} THEN 'ai' ELSE 'human' END AS verdict,
        {r6("CASE WHEN status = 'verified_ai' THEN greatest(stylometry_score, 0.99::DOUBLE) ELSE stylometry_score END")} AS verdict_score, CASE WHEN status = 'verified_ai' THEN '' ELSE coalesce(array_to_string(why, ','), '') END AS reasons FROM wy""", DOCS,
        f"""{STYLE}, {STAND_IN}, cj AS (SELECT st.*, CASE WHEN n_words >= 240 THEN ({AI_SHARE}) END AS share, {STATUS} AS status, c.language IS NOT NULL AS calibrated, c.global_threshold, c.bin_edges, c.bin_thresholds FROM st JOIN si USING (doc_id) LEFT JOIN calibration c ON c.language = st.lang), wy AS (SELECT *, {reasons} AS why FROM cj)""",
    )
    q["src_text"] = "SELECT 6::BIGINT AS n_words, 2::BIGINT AS n_sentences"
    q["det_registry"] = "SELECT * FROM (VALUES ('binoculars', false), ('perplexity', false), ('phrases', true), ('stylometry', true)) AS v(name, available)"
    vowels = "length(regexp_replace(lower(text), '[^aeiou]', '', 'g')) / nullif(length(text), 0)::DOUBLE"
    q["det_transformer"] = f"SELECT doc_id, {r6(f'coalesce({vowels}, 0.5)')} AS vowel_score, coalesce(length(text), 0) > 0 AND coalesce({n_words('text')}, 0) >= 50 AS vowel_reliable FROM documents"
    q["topk_lexicon"] = f"WITH {DOCS}, {hits_cte('d')}, u AS (SELECT unnest(held) AS h FROM hi) SELECT h.phrase AS phrase, CAST(sum(h.n) AS BIGINT) AS n, {r6('sum(h.n * h.weight)')} AS weight FROM u GROUP BY 1 ORDER BY sum(h.n * h.weight) DESC, 1 LIMIT 12"
    q["det_phrases_details"] = f"""WITH {DOCS}, {hits_cte('d')}, u AS (SELECT doc_id, unnest(held) AS h FROM hi), o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY -h.n * h.weight, h.phrase) AS place, h.phrase AS phrase, CAST(h.n AS BIGINT) AS n FROM u)
        SELECT * FROM o WHERE place <= 12"""
    q["streaming_scores"] = texts(f"SELECT lang, count(*) AS n, {r6(f'avg({two})')} AS mean_score FROM ph GROUP BY 1", DOCS, BOTH)
    q["span_windows"] = f"{SPANNED} SELECT doc_id, pos AS \"at\", a, b FROM w"
    q["join_span_windows"] = f"{SPANNED}, c AS (SELECT doc_id, unnest(range(a, b)) AS idx FROM w) SELECT doc_id, idx, count(*) AS n_windows FROM c GROUP BY 1, 2"
    q["span_scores"] = f"""{SPANNED}, ws AS (SELECT w.doc_id * 100000 + w.pos AS wid, array_to_string(se.sents[a + 1:b], ' ') AS text FROM w JOIN se USING (doc_id)),
        js AS (SELECT wid, stylometry_score AS s FROM (WITH d AS (SELECT * FROM ws), {TEXTS}, {STYLE} SELECT * FROM st)),
        c AS (SELECT doc_id, wid, unnest(range(a, b)) AS idx FROM (SELECT *, doc_id * 100000 + pos AS wid FROM w)), pe AS (SELECT doc_id, idx, avg(s) AS s FROM c JOIN js USING (wid) GROUP BY 1, 2),
        sl AS (SELECT doc_id, list(s ORDER BY idx) AS sc FROM pe GROUP BY 1), nwn AS (SELECT doc_id, count(*) AS n_windows FROM w GROUP BY 1),
        al AS (SELECT si.doc_id, nw, coalesce(sl.sc, []) AS sc, coalesce(n_windows, 0) AS n_windows, CAST(coalesce(list_sum(nw), 0) AS BIGINT) AS total_words FROM si LEFT JOIN sl USING (doc_id) LEFT JOIN nwn USING (doc_id))
        SELECT doc_id, n_windows, total_words, n_windows >= 3 AND total_words >= 240 AS reliable, {r6(AI_SHARE)} AS fraction, {r6("coalesce(list_avg(sc), 0)")} AS mean_score FROM al"""
    q["standardizer"] = f"WITH fv AS ({q['feature_vector']}), u AS (UNPIVOT (SELECT {', '.join(FEATURE_NAMES)} FROM fv WHERE n_words > 0) ON COLUMNS(*) INTO NAME feature VALUE v) SELECT feature, {r6('avg(v)')} AS mean, {r6('CASE WHEN stddev_samp(v) > 1e-9 THEN stddev_samp(v) ELSE 1 END')} AS sd FROM u GROUP BY 1"
    return q
