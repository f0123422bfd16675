"""Problem 1: all pairs of records whose sets of word runs have a Jaccard similarity above a threshold, exactly.

The space is that of word-run sets under the Jaccard distance, a metric; two documents are linked if they are nearer
than ``delta = 1 - threshold``. The join is a Voronoi join with document pivots:

*  **Pivots and regions.** Documents that share their smallest run hash meet in a stream sorted by it. Those farther than
   ``0.4 delta`` from every pivot met so far become pivots; each other document belongs to the region of its nearest
   pivot. A region of more than ``LEAF`` documents is divided again around pivots of half the radius, recursively. The
   stream is range-partitioned, so a hash that a third of all documents share is spread over tasks: which
   pivots are taken changes the cost, never the result.
*  **Within a region** any two members are linked by the triangle inequality, d(x, y) <= d(x, p) + d(p, y) < delta, and
   no sets are compared.
*  **Windows.** For two regions p < q, a document y of q is copied to p if it may be linked to a member. That it may is
   found through rare runs: of runs in a common order from rare to frequent, two linked documents share one among their
   first ``n - floor(t n)``. Members and y are compared there by size, by the position of the shared run and by a parity
   image of 256 bits, a map that never increases a distance. What is left must pass the ball window around the
   pivot, d(y, p) < radius(p) + delta, first on images of 1,024 bits, then exactly.
*  **Leaves.** With d(y, p) known, a member x is linked with y for sure if d(x, p) + d(y, p) < delta, for sure not
   if |d(x, p) - d(y, p)| >= delta, and only in between are the two sets compared.

Records with the same words in the same order are one class; classes are compared, and pairs are expanded to records at
the end. Nulls and texts shorter than a run have no sets and no links.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop, written
from .canon import form_query, run_sql
from .components import components

COUNTERS = 1 << 20  # of the rarity table: its size is fixed, whatever the data
RADIUS = 0.4  # of a region, as a part of delta: below one half, so that all members of a region are linked
LEAF, HELD, MET = 32, 512, 24  # members of an undivided region; documents divided at once; pivots a document is held against
SLACK = 1e-9
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Bound:
    """The least overlap for a link: more than ``t`` (strict) or at least ``t`` (inclusive) of the union."""

    def __init__(self, threshold: float, inclusive: bool):
        self.t = Fraction(threshold).limit_denominator(1000)
        self.both = self.t / (1 + self.t)  # of the sum of the two sizes
        self.inclusive = inclusive
        self.delta = float(1 - self.t)

    def least(self, n, part: Fraction):
        """The smallest whole number above (or at) ``part`` of ``n``, for numbers and arrays."""
        return (n * part.numerator + part.denominator - 1) // part.denominator if self.inclusive else n * part.numerator // part.denominator + 1

    def least_sql(self, n: str, part: Fraction) -> str:
        return f"(({n} * {part.numerator} + {part.denominator - 1}) div {part.denominator})" if self.inclusive else f"(({n} * {part.numerator}) div {part.denominator} + 1)"


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def pieces(batch: pa.RecordBatch, at: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``most`` bytes of text in column ``at``; a longer text is a slice of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def raw_runs(texts: pa.Array, width: int, hashes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, run): the 64-bit hash of each run of ``width`` words, and the index of its text, in order of the text.
    Texts are words with single blanks between; all texts of a batch are done at once."""
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten().dictionary_encode()
    one = np.fromiter(map(hashes.__getitem__, flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))[flat.indices.to_numpy()]
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    n = len(one) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    run = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            run = (run ^ one[k : k + n]) * _A
            run ^= run >> np.uint64(29)
            run = run * _B + _C
        run ^= run >> np.uint64(32)
    inside = owner[:n] == owner[width - 1 :]
    return owner[:n][inside], run[inside].view(np.int64)


def _ordered(owner: np.ndarray, run: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distinct runs in the order (owner, rank, run). One sort of a 64-bit key that holds most of the three;
    should two different runs have one key, all three are sorted."""
    few = np.uint64(22)
    key = owner.astype(np.uint64) << (np.uint64(64) - few)
    if rank is None:
        key |= run.view(np.uint64) >> few
    else:
        rank = np.minimum(rank, (1 << 18) - 1)
        key |= (rank.astype(np.uint64) << np.uint64(24)) | (run.view(np.uint64) >> np.uint64(40))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if (same & (run[order[1:]] != run[order[:-1]])).any():
        order = np.lexsort((run.view(np.uint64), owner) if rank is None else (run.view(np.uint64), rank, owner))
    owner, run = owner[order], run[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], run[new]


def run_table(texts: pa.Array, width: int, hashes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ends, runs): the distinct runs of each text, ordered as unsigned numbers, one text after the other."""
    owner, run = _ordered(*raw_runs(texts, width, hashes))
    return np.searchsorted(owner, np.arange(len(texts) + 1)), run


def run_hashes(words: list[str], width: int, hashes: dict[str, int]) -> np.ndarray:
    """The runs of one text."""
    return run_table(pa.array([" ".join(words)]), width, hashes)[1] if words else np.empty(0, np.int64)


def word_texts(records: DataFrame, text: str, rec: str, width: int) -> DataFrame:
    """(rec, words: digest of the word sequence, key: digest of the form of problem 4, low: the smallest run hash, n: the
    number of runs, repeated ones included, loose: the words). ``low`` is null for a text without a run, all but ``rec`` for a null text. A word
    sequence met before in the partition is not repeated: its ``loose`` is null."""
    sql = form_query("rec, sha256(loose) AS words, sha256(key) AS key, loose")

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()

        def with_low(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            rec_, words, key, loose = (c.chunk(0) if c.num_chunks else pa.array([], pa.string()) for c in t.columns)
            owner, runs = raw_runs(pc.fill_null(loose, ""), width, hashes)
            n = np.bincount(owner, minlength=len(loose))
            has = n > 0
            low = np.zeros(len(n), np.int64)
            if len(runs):
                low[has] = np.minimum.reduceat(runs, np.searchsorted(owner, np.flatnonzero(has)))
            fresh = np.ones(len(n), bool)
            for i, w in enumerate(words.to_pylist()):
                fresh[i] = w not in seen
                if len(seen) < 200_000:
                    seen.add(w)
            return pa.table([rec_, words, key, pa.array(low, mask=~has), pa.array(n.astype(np.int32)), pc.if_else(pa.array(fresh & has), loose, pa.scalar(None, pa.string()))], names=["rec", "words", "key", "low", "n", "loose"])

        yield from run_sql(sql, with_low)(batches)

    return records.select(F.col(f"`{rec}`").alias("rec"), F.col(f"`{text}`").alias("text")).mapInArrow(shaped, "rec string, words string, key string, low bigint, n int, loose string")


def distance(x: frozenset[int], y: frozenset[int]) -> float:
    """Jaccard distance of two sets."""
    common = len(x & y)
    return 1.0 - common / (len(x) + len(y) - common)


def divide(sets: list[frozenset[int]], radius: float) -> list[tuple[int, float]]:
    """(index of the pivot, distance from it) for each set: no set is farther than ``radius`` from its pivot, and each
    belongs to the nearest pivot among those it was held against. Regions above ``LEAF`` members are divided again."""
    pivots: list[int] = []
    home: list[tuple[int, float]] = []
    for i, s in enumerate(sets):
        best = (i, 0.0)
        for p in pivots[-MET:]:
            small, large = sorted((len(s), len(sets[p])))
            if small < (1 - radius) * large:  # farther than the radius by their sizes alone
                continue
            d = distance(s, sets[p])
            if d <= radius and (best[0] == i or d < best[1]):
                best = (p, d)
        if best[0] == i:
            pivots.append(i)
        home.append(best)
    members: dict[int, list[int]] = {}
    for i, (p, _) in enumerate(home):
        members.setdefault(p, []).append(i)
    for p, own in members.items():
        if len(own) > LEAF and radius > 0.01:
            for i, (q, d) in zip(own, divide([sets[i] for i in own], radius / 2)):
                home[i] = (own[q], d)
    return home


def voronoi(texts: DataFrame, width: int, bound: Bound) -> DataFrame:
    """(cid, words, loose, home, dist, radius) for each word sequence: the cid of its region's pivot, the distance from
    it, and the largest such distance in the region."""
    radius = RADIUS * bound.delta

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at = _Hashes(), TaskContext.get().partitionId() << 40
        group: list[tuple[str, str, np.ndarray]] = []
        out: list[tuple] = []
        last = None

        def close() -> None:
            nonlocal at
            home = divide([frozenset(s.tolist()) for _, _, s in group], radius) if len(group) > 1 else [(0, 0.0)] * len(group)
            widest: dict[int, float] = {}
            for p, d in home:
                widest[p] = max(widest.get(p, 0.0), d)
            out.extend((at + i, words, loose, at + p, d, widest[p]) for i, ((words, loose, _), (p, d)) in enumerate(zip(group, home)))
            at += len(group)
            group.clear()

        def rows() -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * 6
            done = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64()))], names=["cid", "words", "loose", "home", "dist", "radius"])
            out.clear()
            return done

        before = None
        for whole in batches:
            for b in pieces(whole, 2):
                words, loose = b.column(1).to_pylist(), b.column(2).to_pylist()
                owner, runs = raw_runs(b.column(2), width, hashes)
                ends = np.searchsorted(owner, np.arange(b.num_rows + 1))
                for i, low in enumerate(b.column(0).to_pylist()):
                    if words[i] == before:
                        continue
                    before = words[i]
                    if low != last or len(group) >= HELD:
                        close()
                        last = low
                    group.append((words[i], loose[i], runs[ends[i] : ends[i + 1]]))
                yield rows()
        close()
        yield rows()

    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = texts.filter("loose is not null").select("low", "words", "loose", "n")
    sorted_ = seen.repartitionByRange(parts, "low", "words").sortWithinPartitions("low", "n", "words").select("low", "words", "loose")
    return sorted_.mapInArrow(work, "cid bigint, words string, loose string, home bigint, dist double, radius double")


def _counts(classes: DataFrame, width: int) -> np.ndarray:
    """How many runs of all classes fall on each counter, a class's repeated runs counted again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(COUNTERS, np.int64), _Hashes()
        for b in (p for whole in batches for p in pieces(whole, 0)):
            total += np.bincount(raw_runs(b.column(0), width, hashes)[1] & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)]), pa.array(total[at[k : k + (1 << 16)]])], names=["counter", "n"])

    rows = classes.select("loose").mapInArrow(work, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32)


def _parity(owner: np.ndarray, runs: np.ndarray, n: int, bits: int, shift: int) -> np.ndarray:
    """``bits`` parity bits of each of ``n`` sets, as rows of 64-bit numbers."""
    odd = (np.bincount(owner * bits + ((runs >> shift) & (bits - 1)), minlength=bits * n) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, bits), axis=1).view(np.int64)


def windows(classes: DataFrame, counts, width: int, bound: Bound) -> DataFrame:
    """One row per class and rare run: run, cid, home, n, pos (of the run in the class's order), b0..b3 (parity)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashes = counts.value, _Hashes()
        for whole in batches:
            for b in pieces(whole, 2):
                owner, runs = raw_runs(b.column(2), width, hashes)
                owner, runs = _ordered(owner, runs, table[runs & (COUNTERS - 1)])
                sizes = np.bincount(owner, minlength=b.num_rows)
                bits = _parity(owner, runs, len(sizes), 256, 40)
                pos = np.arange(len(runs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = pos < (sizes - bound.least(sizes, bound.t) + 1)[owner]
                w = owner[keep]
                columns = (runs[keep], b.column(0).to_numpy()[w], b.column(1).to_numpy()[w], sizes[w].astype(np.int32), pos[keep].astype(np.int32), *(bits[w, j] for j in range(4)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["run", "cid", "home", "n", "pos", "b0", "b1", "b2", "b3"])

    return classes.select("cid", "home", "loose").mapInArrow(work, "run bigint, cid bigint, home bigint, n int, pos int, b0 bigint, b1 bigint, b2 bigint, b3 bigint")


def _marked(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (cid, radius, loose) that may be in a pair: ids are marked in a bitmap of fixed size, so that most
    classes without a candidate need not be sent. A false mark costs a row, no mark is ever missing."""
    mark = F.pmod(F.xxhash64("cid"), F.lit(COUNTERS))
    marks = pairs.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).select(mark.alias("m")).distinct().toArrow().column(0).to_numpy()
    table = np.zeros(COUNTERS, bool)
    table[marks] = True
    held = classes.sparkSession.sparkContext.broadcast(np.packbits(table))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(held.value).astype(bool)
        for b in batches:
            yield b.filter(pa.array(bits[b.column(3).to_numpy()])).select(["cid", "radius", "loose"])

    return classes.select("cid", "radius", "loose", mark.alias("m")).mapInArrow(work, "cid bigint, radius double, loose string")


def _wide_images(marked: DataFrame, width: int) -> DataFrame:
    """(cid, n, radius, i0..i15): a parity image of 1,024 bits, which tells long texts apart too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in (p for whole in batches for p in pieces(whole, 2)):
            ends, runs = run_table(b.column(2), width, hashes)
            sizes = np.diff(ends)
            image = _parity(np.repeat(np.arange(len(sizes)), sizes), runs, len(sizes), 1024, 20)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int32)), b.column(1), *(pa.array(image[:, k].copy()) for k in range(16))], names=["cid", "n", "radius", *(f"i{k}" for k in range(16))])

    return marked.mapInArrow(work, "cid bigint, n int, radius double, " + ", ".join(f"i{k} bigint" for k in range(16)))


def _sets(marked: DataFrame, width: int) -> DataFrame:
    """(cid, radius, runs)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in (p for whole in batches for p in pieces(whole, 2)):
            ends, runs = run_table(b.column(2), width, hashes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(runs))], names=["cid", "radius", "runs"])

    return marked.mapInArrow(work, "cid bigint, radius double, runs array<bigint>")


def _compared(pairs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(cid_a, cid_b, radius of a, n_both, n_common) of the pairs, on whole sets."""
    sets = _sets(_marked(classes, pairs), width)
    # one struct for both sides, so that they read one and the same shuffle
    held = sets.select("cid", F.struct("radius", "runs").alias("s"))
    both = pairs.select("cid_a", "cid_b").join(held.toDF("cid_a", "a"), "cid_a").join(held.toDF("cid_b", "b"), "cid_b")
    return both.select("cid_a", "cid_b", "a.radius", (F.size("a.runs") + F.size("b.runs")).alias("n_both"), F.size(F.array_intersect("a.runs", "b.runs")).alias("n_common"))


def similar_classes(classes: DataFrame, width: int, bound: Bound) -> DataFrame:
    """(cid_a, cid_b) of all linked classes, each pair once."""
    spark = classes.sparkSession
    t, both, delta = bound.t, bound.both, bound.delta
    counts = spark.sparkContext.broadcast(_counts(classes, width))
    rows = windows(classes, counts, width, bound)
    a, b = rows.alias("a"), rows.alias("b")
    # The smaller set's window is shorter. The condition names both sides, so that it stays in the join and both sides
    # read one and the same shuffle.
    inner = f"least(a.pos, a.pos + b.pos) < a.n - {bound.least_sql('a.n', 2 * both)} + 1"
    need = bound.least_sql("(a.n + b.n)", both)
    far = " + ".join(f"bit_count(a.b{i} ^ b.b{i})" for i in range(4))
    met = a.join(
        b,
        F.expr(
            f"a.run = b.run AND a.home <> b.home AND {inner} AND (a.n < b.n OR (a.n = b.n AND a.cid < b.cid)) AND b.n * {t.numerator} {'<=' if bound.inclusive else '<'} a.n * {t.denominator} "
            f"AND 1 + least(a.n - 1 - a.pos, b.n - 1 - b.pos) >= {need} AND {far} <= a.n + b.n - 2 * {need}"
        ),
    )
    # a document goes to the region of the smaller name: (region's pivot, visitor)
    visits = written(met.selectExpr("least(a.home, b.home) AS cid_a", "if(a.home < b.home, b.cid, a.cid) AS cid_b").distinct(), "visits")
    # the ball window, on images
    images = _wide_images(_marked(classes, visits), width)
    x, y = images.alias("x"), images.alias("y")
    far = " + ".join(f"bit_count(x.i{k} ^ y.i{k})" for k in range(16))
    ball = f"{far} <= (x.radius + {delta!r}) / (2 - x.radius - {delta!r}) * (x.n + y.n) + {SLACK}"
    near = written(visits.join(x, F.expr("cid_a = x.cid")).join(y, F.expr(f"cid_b = y.cid AND {ball}")).select("cid_a", "cid_b"), "near")
    # ... and exactly
    seen = _compared(near, classes, width).withColumn("dist", F.expr("1D - n_common / (n_both - n_common)"))
    seen = written(seen.filter(F.col("dist") <= F.col("radius") + delta + SLACK), "seen")
    links = seen.filter(F.expr(f"n_common >= {bound.least_sql('n_both', both)}")).select("cid_a", "cid_b")
    members = classes.filter("home <> cid").select("home", "cid", F.col("dist").alias("own"))
    leaves = seen.filter("radius > 0").join(members, F.col("cid_a") == F.col("home")).select(F.col("cid").alias("cid_a"), "cid_b", "dist", "own")
    sure = leaves.filter(F.col("dist") + F.col("own") < delta - SLACK).select("cid_a", "cid_b")
    unsure = written(leaves.filter((F.col("dist") + F.col("own") >= delta - SLACK) & (F.abs(F.col("dist") - F.col("own")) <= delta + SLACK)).select("cid_a", "cid_b"), "unsure")
    verified = _compared(unsure, classes, width).filter(F.expr(f"n_common >= {bound.least_sql('n_both', both)}")).select("cid_a", "cid_b")
    of_pivot = members.select(F.col("home").alias("cid_a"), F.col("cid").alias("cid_b"))
    one, two = members.alias("one"), members.alias("two")
    inside = one.join(two, F.expr("one.home = two.home AND one.cid < two.cid")).select(F.col("one.cid").alias("cid_a"), F.col("two.cid").alias("cid_b"))
    done = written(links.unionAll(sure).unionAll(verified).unionAll(of_pivot).unionAll(inside), "links")
    for table in (visits, near, seen, unsure):
        drop(table)
    counts.destroy()
    return done


def _linked(records: DataFrame, text: str, rec: str, width: int, threshold: float, inclusive: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records with the digests of their words, classes, links), all written."""
    bound = Bound(threshold, inclusive)
    texts = written(word_texts(records, text, rec, width), "words")
    classes = written(voronoi(texts, width, bound), "classes")
    return texts, classes, similar_classes(classes, width, bound)


def _finished(df: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    done = written(df, name)
    for table in used:
        drop(table)
    return done


def near_duplicate_pairs(records: DataFrame, text: str = "text", rec: str = "rec", width: int = 5, threshold: float = 0.8, inclusive: bool = True) -> DataFrame:
    """Pairs (rec_a, rec_b), rec_a first by code point, with a similarity of at least the threshold (above it unless
    ``inclusive``), without those that are the same but for formatting (problem 4)."""
    texts, classes, links = _linked(records, text, rec, width, threshold, inclusive)
    some = links.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).distinct()
    named = texts.select("rec", "words", "key").join(classes.select("cid", "words").join(some, "cid", "left_semi"), "words").select("cid", "rec", "key")
    a = named.toDF("cid_a", "a", "key_a")
    b = named.toDF("cid_b", "b", "key_b")
    pairs = links.join(a, "cid_a").join(b, "cid_b").filter("key_a <> key_b").select(F.least("a", "b").alias("rec_a"), F.greatest("a", "b").alias("rec_b"))
    return _finished(pairs, "pairs", texts, classes, links)


def near_duplicate_groups(records: DataFrame, text: str = "text", rec: str = "rec", width: int = 5, threshold: float = 0.8, inclusive: bool = True) -> DataFrame:
    """One row (rec, group_id, n_links) for each record: its connected component, named by the smallest rec, and the
    number of other word sequences it is linked to. Records without a run are grouped by equal word sequences; a
    record with a null text is a group of its own. Both have no links."""
    texts, classes, links = _linked(records, text, rec, width, threshold, inclusive)
    linked = links.select(F.col("cid_a").alias("cid")).unionAll(links.select("cid_b")).groupBy("cid").agg(F.count("*").alias("n_links"))
    labels = components(links.toDF("a", "b"))
    labelled = classes.select("cid", "words").join(labels.toDF("cid", "label"), "cid", "left").join(linked, "cid", "left").select("words", F.coalesce("label", "cid").cast("string").alias("label"), "n_links")
    named = texts.select("rec", "words").join(labelled, "words", "left")
    # names of classes are digits, of word sequences without a run w: and a digest, of null texts r: and the record
    own = F.coalesce(F.col("label"), F.concat(F.lit("w:"), F.col("words")), F.concat(F.lit("r:"), F.col("rec")))
    named = named.select("rec", own.alias("label"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    names = named.groupBy("label").agg(F.min("rec").alias("group_id"))
    return _finished(named.join(names, "label").select("rec", "group_id", "n_links"), "groups", texts, classes, links)
