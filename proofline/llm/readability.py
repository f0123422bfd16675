"""Problem 9: the reading level of each document, by harmonic propagation on a graph of documents and words.

Documents and words are the nodes; each document is joined with its distinct words. Graded documents are clamped to the
mean of their grades. In each iteration a word takes the mean of its documents and a document the mean of its words.
Word nodes are hashed to ``WORD_NODES`` nodes, so the words' values are a table of fixed size that is broadcast; the
documents stay where they are and only sums by word node are shuffled. The iterations end when the words' values, as
standard scores weighted by their documents, move by less than ``TOLERANCE`` (root mean square); that always happens, as
harmonic iterations converge. Levels are cut where the graded documents' own unclamped values separate best.

Only English running prose gets a level: texts that meet the published rules of running text (problem 2: stop words,
words with letters, bullets) and hold at least as many stop words of English as of any other language. Everything else, null and empty texts included, has a null level and the reason for it. Without any
usable grade all levels are null. Repeated grades of one document are averaged; null grades are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .canon import forms
from .quality import MAX_BULLET_LINES, MIN_ALPHABETIC_WORDS, MIN_STOP_WORDS, STOP_WORDS

WORD_NODES = 1 << 18
TOLERANCE = 0.002
CELLS, NEAR, SLACK = 4000, 25, 0.05  # where and how the cuts are looked for
# --- fixed values -------------------------------------------------------------------------------------
LEVELS = (1, 2, 3, 4)
# lines with a bullet or number in front, and lines with anything on them
BULLETS_SQL = r"len(regexp_extract_all(visual, '(?m)^[ \t]*(?:[-*+•‣▪]|[0-9]{1,3}[.)])[ \t]+[^ \t\n]'))"
LINES_SQL = r"len(regexp_extract_all(visual, '(?m)^.*[^ \t\n].*$'))"
NO_WORDS, NOT_ENGLISH_PROSE, NO_GRADES = "no_words", "not_english_prose", "no_grades"
# --------------------------------------------------------------------------------------------------------


class _Nodes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        # numbers and one-letter words carry no difficulty
        value = self[word] = -1 if len(word) < 2 or word.isdigit() else xxhash.xxh3_64_intdigest(word) % WORD_NODES
        return value


_STOP = {language: frozenset(own) for language, own in STOP_WORDS.items()}


def english_prose(words: list[str], bullets: int, lines: int) -> bool:
    """Whether lower-case words of a text, with its lines and bulleted lines, are English running text."""
    held = {language: sum(map(own.__contains__, words)) for language, own in _STOP.items()}
    return (
        held["en"] >= MIN_STOP_WORDS
        and held["en"] == max(held.values())
        and len(words) - sum(map(str.isdigit, words)) >= MIN_ALPHABETIC_WORDS * len(words)
        and bullets <= MAX_BULLET_LINES * lines
    )


def word_nodes(documents: DataFrame, text: str, id: str) -> DataFrame:  # noqa: A002
    """(id, nodes, reason) for each text: its distinct word nodes, or none and the reason why it can't be levelled."""
    loose = forms(documents, text, {"loose": "loose", "bullets": f"CAST({BULLETS_SQL} AS VARCHAR)", "lines": f"CAST({LINES_SQL} AS VARCHAR)"}, [id])
    kind = loose.schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = _Nodes()
        for b in batches:
            lists, reasons = [], []
            for t, bullets, lines in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                words, own, reason = (t or "").split(), set(), None
                if not words:
                    reason = NO_WORDS
                elif not english_prose(words, int(bullets), int(lines)):
                    reason = NOT_ENGLISH_PROSE
                else:
                    own = {nodes[w] for w in set(words)}
                    own.discard(-1)
                lists.append(np.fromiter(own, np.int32, len(own)))
                reasons.append(reason)
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            values = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(reasons, pa.string())], names=["id", "nodes", "reason"])

    return loose.mapInArrow(work, f"id {kind}, nodes array<int>, reason string")


def _unpacked(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    lists = b.column(at)
    ends = lists.offsets.to_numpy()
    return lists.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def _means(flat: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.add.reduceat(words[flat], ends[:-1]) / np.diff(ends)


def _standard(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values as standard scores, each word weighted by its documents."""
    mean = np.average(words, weights=n)
    spread = np.sqrt(np.average((words - mean) ** 2, weights=n))
    return (words - mean) / spread if spread > 1e-12 else words - mean


def propagate(graph: DataFrame, tolerance: float = TOLERANCE) -> np.ndarray | None:
    """The word nodes' values when they have settled, for (grade, nodes); None without grades."""
    spark = graph.sparkSession
    start = graph.agg(F.avg("grade")).first()[0]
    if start is None:
        return None
    before = None
    words = np.full(WORD_NODES, start, np.float64)
    while True:
        held = spark.sparkContext.broadcast(words)

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(WORD_NODES), np.zeros(WORD_NODES, np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                flat, ends = _unpacked(b, 1)
                grade = b.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
                value = np.where(np.isnan(grade), _means(flat, ends, held.value), grade)
                total += np.bincount(flat, np.repeat(value, np.diff(ends)), WORD_NODES)
                n += np.bincount(flat, minlength=WORD_NODES)
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(n[at])], names=["node", "total", "n"])

        sums = graph.mapInArrow(work, "node int, total double, n bigint").groupBy("node").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        words = np.full(WORD_NODES, start, np.float64)
        at, n = sums.column(0).to_numpy(), np.zeros(WORD_NODES)
        n[at] = sums.column(2).to_numpy()
        words[at] = sums.column(1).to_numpy() / n[at]
        held.destroy()
        now = _standard(words, n)
        if before is not None and np.sqrt(np.average((now - before) ** 2, weights=n)) < tolerance:
            return words
        before = now


def _cuts(scored: DataFrame) -> list[float]:
    """Scores between the levels. Graded documents say where a cut makes few errors: within ``SLACK`` of the fewest. In
    that range the cut goes where the fewest documents, graded or not, are, as levels differ more between than within.
    Both are counts per cell of the score's range: at most ``CELLS`` rows each."""
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    width = max(high - low, 1e-9) / CELLS
    cell = F.least(F.floor((F.col("score") - low) / width), F.lit(CELLS - 1)).cast("int")
    rows = scored.groupBy(cell.alias("cell"), F.round("grade").cast("int").alias("level")).agg(F.count("*").alias("n")).collect()
    every = np.zeros(CELLS)
    for r in rows:
        every[r.cell] += r.n
    around = np.convolve(every, np.ones(2 * NEAR + 1), "same")
    around = np.concatenate([around, around[-1:]])  # of the cut below each cell, and above the last
    cuts = []
    for level in LEVELS[:-1]:
        below, above = np.zeros(CELLS + 1), np.zeros(CELLS + 1)
        for r in rows:
            if r.level is not None:
                (above if r.level > level else below)[r.cell + 1] += r.n
        wrong = np.cumsum(above) + below.sum() - np.cumsum(below)
        good = np.flatnonzero(wrong <= wrong.min() * (1 + SLACK) + 1e-9)
        thin = good[around[good] <= around[good].min() + 1e-9]
        cuts.append(low + width * float(thin[len(thin) // 2]))
    return list(np.maximum.accumulate(cuts))


def document_levels(documents: DataFrame, grades: DataFrame, text: str = "text", id: str = "doc_id", grade: str = "level", tolerance: float = TOLERANCE) -> DataFrame:  # noqa: A002
    """(id, score, level, reason) for each document; the score runs from easy to hard. Where there is no level, score
    and level are null and the reason says why; elsewhere the reason is null."""
    spark = documents.sparkSession
    graded = grades.filter(F.col(f"`{grade}`").isNotNull()).groupBy(F.col(f"`{id}`").alias("id")).agg(F.avg(f"`{grade}`").alias("grade"))
    every = written(word_nodes(documents, text, id).join(graded, "id", "left").select("id", "grade", "nodes", "reason"), "graph")
    graph = every.filter("reason is null").select("id", "grade", "nodes")
    unlevelled = lambda df, reason: df.select("id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("level"), reason.alias("reason"))
    words = propagate(graph.select("grade", "nodes"), tolerance)
    kind = graph.schema["id"].dataType.simpleString()
    if words is None:
        return unlevelled(every, F.coalesce("reason", F.lit(NO_GRADES))).withColumnRenamed("id", id)
    held = spark.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_means(*_unpacked(b, 2), held.value))], names=["id", "grade", "score"])

    scored = written(graph.mapInArrow(work, f"id {kind}, grade double, score double"), "scores")
    level = F.lit(LEVELS[0])
    for cut in _cuts(scored):
        level = level + F.when(F.col("score") >= cut, 1).otherwise(0)
    levelled = scored.select("id", "score", level.cast("int").alias("level"), F.lit(None).cast("string").alias("reason"))
    return levelled.unionByName(unlevelled(every.filter("reason is not null"), F.col("reason"))).withColumnRenamed("id", id)


def reading_levels(documents: DataFrame, grades: DataFrame, text: str = "text", id: str = "doc_id", grade: str = "level", tolerance: float = TOLERANCE) -> DataFrame:  # noqa: A002
    """(id, score, level) for each document in English prose only: ``document_levels`` without the others."""
    prose = F.coalesce("reason", F.lit(NO_GRADES)) == NO_GRADES
    return document_levels(documents, grades, text, id, grade, tolerance).filter(prose).drop("reason")
