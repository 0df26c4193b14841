"""Periodic runs of words: longest common extensions over a difference cover drive a harmonic grid.

A run is a stretch of consecutive words of one text with smallest period q (words q
apart are identical), at least ``min_length`` words and ``min_exponent`` periods
long, that no neighbouring word extends.

Per block of texts, inside a task: word hashes of all texts follow each other, a
word of its own behind each text.  Of all suffixes only those at places of a
difference cover modulo ``STRIDE`` are sorted, by doubling over blocks of STRIDE
words.  The extension of two places compares words until both meet the cover
(fewer than STRIDE of them, mostly one or two), then reads the blocks both share
from a sparse table of range minima, and compares the words of the first block
that differs.  A run of period p covers at least max(min_length, min_exponent p) - p
pairs (i, i + p), so one pair of each grid of that step lies in it: for every p
the grid's pairs with equal words are extended both ways.  Multiples of a period give the
same stretch (Fine and Wilf), so the smallest period of a stretch is its period.

Defined cases: a null text has no words and no runs, and its kept text is ""; words are
told apart by 64-bit hashes; equal texts and repeated rows are judged each; a very long text
makes a block of its own, with memory in proportion to n log n of its words; only the named columns are
read, so further columns of any name do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stallworks.functions.binding import let
from stallworks.llm.words import blocks, mix, words_of

STRIDE, ROOT = 64, 8
#: places modulo STRIDE: every difference is one of a multiple of ROOT and a number below ROOT
COVER = np.unique(np.concatenate([np.arange(ROOT), np.arange(0, STRIDE, ROOT)]))
_ORDER = np.full(STRIDE, -1)
_ORDER[COVER] = np.arange(len(COVER))
_INSIDE = _ORDER >= 0
#: words from places i, j (modulo STRIDE) until both are in the cover
SHIFT = np.array([[next(k for k in range(STRIDE) if _INSIDE[(i + k) % STRIDE] and _INSIDE[(j + k) % STRIDE]) for j in range(STRIDE)]
                  for i in range(STRIDE)])
PAIRS = 1 << 21
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 2**64)


def _own(n: int, salt: int) -> np.ndarray:
    """n words that occur nowhere else."""
    return mix(np.arange(n, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(salt))


def _powers(step: int, n: int) -> np.ndarray:
    steps = np.full(n, step, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class Extensions:
    """Longest common extensions to the right of pairs of places in a sequence of 64-bit words."""

    def __init__(self, words: np.ndarray):
        # words of their own behind the end, so that every extension ends
        self.whole = -(-(len(words) + 1) // STRIDE) * STRIDE
        self.words = np.concatenate([words, _own(self.whole + 2 * STRIDE - len(words), 0x9E3779B97F4A7C15)])
        places = (np.arange(0, self.whole, STRIDE)[:, None] + COVER).ravel()
        self.levels = self._ranks(places)
        self.rank = self.levels[-1]
        self.table = self._minima(places)

    def _ranks(self, places: np.ndarray) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first 1, 2, 4, ... blocks of STRIDE words, until all differ."""
        n = len(self.words)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.words + np.uint64(1)) * _powers(_STEP, n))])
        named = mix((total[places + STRIDE] - total[places]) * _powers(_BACK, n)[places])
        levels = [np.unique(named, return_inverse=True)[1]]
        span = len(COVER)
        while levels[-1].max(initial=0) + 1 < len(places):
            rank = levels[-1]
            after = np.zeros_like(rank)
            after[:-span] = rank[span:] + 1
            levels.append(np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1])
            span *= 2
        return levels

    def _minima(self, places: np.ndarray) -> list[np.ndarray]:
        """Sparse table over the blocks that neighbours in the sorted order share."""
        order = np.argsort(self.rank)
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.levels) - 2, -1, -1):
            rank, step = self.levels[level], len(COVER) << level
            inside = (a < len(rank)) & (b < len(rank))
            same = inside.copy()
            same[inside] = rank[a[inside]] == rank[b[inside]]
            shared[same] += 1 << level
            a[same] += step
            b[same] += step
        table = [shared]
        while len(table[-1]) > 1 << (len(table) - 1):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def _blocks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Blocks that two sampled suffixes share."""
        x, y = (self.rank[(p // STRIDE) * len(COVER) + _ORDER[p % STRIDE]] for p in (a, b))
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.zeros(len(a), dtype=np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out

    def _compare(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words from a and b on, up to a limit each."""
        out = np.zeros(len(a), dtype=np.int64)
        open_ = np.flatnonzero(limit > 0)
        step = 0
        while len(open_):
            open_ = open_[self.words[a[open_] + step] == self.words[b[open_] + step]]
            out[open_] += 1
            step += 1
            open_ = open_[limit[open_] > step]
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shift = SHIFT[a % STRIDE, b % STRIDE]
        out = self._compare(a, b, shift)
        met = np.flatnonzero((out == shift) & (np.maximum(a, b) + shift < self.whole))
        if len(met):
            x, y = a[met] + shift[met], b[met] + shift[met]
            far = self._blocks(x, y) * STRIDE
            out[met] += far + self._compare(x + far, y + far, np.full(len(met), STRIDE))
        return out


def _grid(sizes: np.ndarray, min_length: int, min_exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of the grid pairs of all texts, in parts of about PAIRS; one period of a text stays whole."""
    periods = np.where(sizes >= min_length, sizes // min_exponent, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(min_length, min_exponent * period) - period
    counts = (sizes[text] - period - 1) // step + 1
    ends = np.cumsum(counts)
    low = 0
    while low < len(text):
        base = ends[low] - counts[low]
        high = max(low + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
        n = counts[low:high]
        which = np.repeat(np.arange(low, high), n)
        place = (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * step[which]
        yield text[which], place, period[which]
        low = high


def runs_of(hashes: np.ndarray, bounds: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, sorted; words of text i are hashes[bounds[i]:bounds[i + 1]]."""
    sizes = np.diff(bounds)
    base = bounds[:-1] + np.arange(len(sizes))
    words = np.empty(len(hashes) + len(sizes), dtype=np.uint64)
    gaps = base + sizes
    inner = np.ones(len(words), dtype=bool)
    inner[gaps] = False
    words[inner] = hashes
    words[gaps] = _own(len(gaps), 0xC2B2AE3D27D4EB4F)
    right = left = None
    found = [np.zeros((0, 4), dtype=np.int64)]
    for text, place, period in _grid(sizes, min_length, min_exponent):
        i = base[text] + place
        hit = np.flatnonzero(words[i] == words[i + period])
        if not len(hit):
            continue
        if right is None:
            right, left, last = Extensions(words), Extensions(words[::-1]), len(words) - 1
        text, i, period = text[hit], i[hit], period[hit]
        after = right(i, i + period)
        before = left(last - i, last - i - period) - 1
        length = before + period + after
        good = length >= np.maximum(min_length, min_exponent * period)
        found.append(np.stack([text, i - before - base[text], length, period], axis=1)[good])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _kept(text: bytes, runs: np.ndarray) -> bytes:
    """Words outside all but the first period of every run, joined by spaces."""
    words = text.split()
    if len(runs):
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [w for w, inside in zip(words, (np.cumsum(change[:-1]) > 0).tolist()) if not inside]
    return b" ".join(words)


def periodic_runs(df: DataFrame, text: Column, carry: dict[str, Column], min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """The carried columns, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``kept_text`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "run_text"):
                texts = part.column(part.num_columns - 1)
                words = words_of(texts)
                rows = runs_of(words.hashes, words.bounds, min_length, min_exponent)
                cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
                triples = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
                kept = [_kept(t.as_buffer().to_pybytes() if t.is_valid else b"", rows[cuts[i]:cuts[i + 1], 1:])
                        for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(np.diff(words.bounds)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), triples),
                     pa.array(kept, pa.binary()).cast(pa.string())],
                    names=[*part.schema.names[:-1], "n_words", "runs", "kept_text"])

    names = {c: f"carried_{i}" for i, c in enumerate(carry)}
    source = df.select(*(c.alias(names[k]) for k, c in carry.items()), text.alias("run_text"))
    types = [f"{names[k]} {source.schema[names[k]].dataType.simpleString()}" for k in carry]
    schema = ", ".join([*types, "n_words long", "runs array<struct<start:long,length:long,period:long>>", "kept_text string"])
    done = source.mapInArrow(run, schema)
    return done.select(*(F.col(v).alias(k) for k, v in names.items()), "n_words", "runs", "kept_text")


WORD = "[^\\x20\\x09-\\x0D]+"


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, in one of ten documents (by CRC-32 of the id) with a stretch repeated up to its end.

    With g = crc32 div 10 and n words: from word a = g mod n on, every word is the one of
    a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def repeated(v: Column) -> Column:
        w, a, p = v["w"], v["a"], v["p"]
        places = F.sequence(F.lit(0), F.size(w) - 1)
        return F.array_join(F.transform(places, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    def start(v: Column) -> Column:
        n = F.size(v["w"])
        a = F.pmod(v["g"], n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(v["g"], F.lit(8))))).cast("int")
        return F.when(n > 0, let(F.struct(v["w"].alias("w"), a.alias("a"), p.alias("p")), repeated)).otherwise("")

    chosen = F.pmod(h, F.lit(10)) == 0
    return F.when(chosen & text.isNotNull(), let(F.struct(found.alias("w"), F.floor(h / 10).cast("long").alias("g")), start)).otherwise(text)


def planted_runs(docs: DataFrame) -> DataFrame:
    """Runs of all documents, planted ones among them: their number, the one with most periods, and digests of all runs and of the kept text."""
    text = with_planted_runs(F.col("doc_id"), F.col("text"))
    found = periodic_runs(docs, text, {"doc_id": F.col("doc_id")})
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                   r["period"].cast("string"), F.lit("\n")))
    # equal fractions are equal doubles, and different ones differ while a text has fewer than 2**26 words
    order = F.transform("runs", lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length")))
    best = found.withColumn("best", F.array_max(order))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))
