"""Substring dedup: repeated windows of words, by FM-indexes of shards.

A window is 20 consecutive words of a document.  A window whose words also
start earlier (smaller document, or earlier in the same one) is a repeat, and
every word that a repeat covers goes.

Text is dealt to shards by content, so that each document is searched in one
index per place instead of in all of them: the smallest hash of a 6-word run
within a window names the window's shard, and neighbouring windows with the same
smallest run form one piece.  All occurrences of a window therefore lie in
pieces of one name.  Pieces whose name occurs once in the corpus hold no repeat
and end there; equal pieces are held once, at their first place (the windows of
the others are repeats).

In each shard the distinct pieces are indexed, laid out by document and place:
the Burrows-Wheeler transform of their sorted suffixes in a wavelet matrix, every
eighth place of the suffix array, and the common prefixes of neighbouring
suffixes, of which 20 words count.  The pieces are streamed against it backward,
word by word: an interval that a further word would leave without a second suffix
falls back to its parent, so every word gets its matching statistic (the longest
match with another place that begins there, 20 at most).  Words that reach 20
report their interval; all its windows are repeats, except at its earliest place.

A name with very many distinct pieces (the edge of a passage that countless
documents share) would overfill one shard: its pieces are cut by the smallest
hash of a 13-word run, and where that is not enough into single windows, which
get names of their own and spread over all shards.

Defined cases: a null or empty text has no words; equal texts under one id count
in the order of generated keys, and null ids come last; a document of fewer than
20 words loses nothing; very long texts are cut into overlapping pieces and lose no window; only the named columns are
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stallworks.llm.tables import Scratch, keyed
from stallworks.llm.words import Words, blocks, mix, sorted_groups, words_of

WINDOW, RUN = 20, 6
#: words in the index of a shard
SHARD_WORDS = 200_000
#: distinct pieces of one name beyond which it is cut by longer runs, and the lengths of these
CROWDED, LONGER_RUNS = 1024, (13, WINDOW)
#: one in how many places of the suffix array is kept
SAMPLE = 8
#: windows that are streamed one after another
STREAM = 64
_STEP = 0x9E3779B97F4A7C15
_PLACE = np.uint64(0xFFFF)


def _window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, wherever it lies."""
    out = np.zeros(max(len(h) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(_STEP) + h[k:len(h) - width + 1 + k]
    return mix(out)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every range, one range after another."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _least_runs(h: np.ndarray, run: int) -> np.ndarray:
    """Smallest hash of the runs in every window, with the run's place in the last 16 bits."""
    runs = _window_hashes(h, run)
    low = (runs & ~_PLACE) | (np.arange(len(runs)).astype(np.uint64) & _PLACE)
    width, span = 1, WINDOW - run + 1
    while 2 * width <= span:
        low = np.minimum(low[:len(low) - width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    return low


def _grouped(h: np.ndarray, at: np.ndarray, new: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of the windows at ``at`` that begin where ``new``: first window, windows, key, whether the name's run moves."""
    begin = np.flatnonzero(new)
    count = np.diff(np.concatenate([begin, [len(at)]]))
    shifts = np.concatenate([[0], (place[1:] != place[:-1]) & ~new[1:]]).astype(np.int64)
    moved = np.add.reduceat(shifts, begin) > 0
    # hash of the words of a whole piece, from sums over all words before
    n, one = len(h), np.ones(1, np.uint64)
    powers = np.multiply.accumulate(np.concatenate([one, np.full(n, _STEP, np.uint64)]))
    back = np.multiply.accumulate(np.concatenate([one, np.full(n, pow(_STEP, -1, 2**64), np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers[:-1])])
    head = at[begin]
    key = mix((sums[head + count + WINDOW - 1] - sums[head]) * back[head] + count.astype(np.uint64))
    return begin, count, key, moved


def pieces(words: Words) -> tuple[np.ndarray, ...]:
    """text, start (word of the text), windows, name, key and whether the name's run moves, of every piece."""
    sizes = np.diff(words.bounds)
    windows = np.maximum(sizes - WINDOW + 1, 0)
    total = int(windows.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    text = np.repeat(np.arange(len(sizes)), windows)
    first = np.cumsum(windows) - windows
    at = np.arange(total) - first[text] + words.bounds[:-1][text]
    least = _least_runs(words.hashes, RUN)[at]
    name, place = least >> np.uint64(16), least & _PLACE
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (name[1:] != name[:-1])])
    begin, count, key, moved = _grouped(words.hashes, at, new, place)
    return text[begin], at[begin] - words.bounds[:-1][text[begin]], count, name[begin], key, moved


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch):
            _, _, _, name, _, moved = pieces(words_of(part.column(1)))
            values, inverse = np.unique(name, return_inverse=True)
            n = np.bincount(inverse, weights=1 + moved, minlength=len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(n)], names=["name", "n"])


def _list_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(0).to_numpy()
        done = 0
        for part in blocks(batch):
            text, start, count, name, key, _ = pieces(words_of(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[done + text]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)),
                 pa.array(name.astype(np.int64)), pa.array(key.view(np.int64))], names=["row", "start", "windows", "name", "key"])
            done += part.num_rows


def _held(part: pa.RecordBatch, words: Words) -> tuple[np.ndarray, ...]:
    """row, start, windows, name and first word of the pieces listed in the third column of (row, text, held)."""
    held = part.column(2)
    owner = np.repeat(np.arange(part.num_rows), np.diff(held.offsets.to_numpy()))
    flat = held.flatten()
    start, count, name = (flat.field(i).to_numpy() for i in range(3))
    return part.column(0).to_numpy()[owner], start, count, name, words.bounds[:-1][owner] + start


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, held: list of (start, windows, name)) -> one row per piece with its word hashes."""
    for batch in batches:
        for part in blocks(batch):
            words = words_of(part.column(1))
            row, start, count, name, head = _held(part, words)
            held_words = [words.hashes[h:h + c + WINDOW - 1].tobytes() for h, c in zip(head, count)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(start), pa.array(count), pa.array(name), pa.array(held_words, pa.binary())],
                names=["row", "start", "windows", "name", "words"])


def _split(run: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, text, held) -> the held pieces cut by the smallest run of ``run`` words; runs as long as a window stand alone."""
        for batch in batches:
            for part in blocks(batch):
                words = words_of(part.column(1))
                row, start, count, name, head = _held(part, words)
                if not len(row):
                    continue
                each = np.repeat(np.arange(len(row)), count)
                offset = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                at = head[each] + offset
                least = _least_runs(words.hashes, run)[at]
                named = mix((least >> np.uint64(16)) ^ mix(name.view(np.uint64)[each] + np.uint64(run)))
                new = np.concatenate([[True], (each[1:] != each[:-1]) | (named[1:] != named[:-1])]) | (run == WINDOW)
                begin, size, key, moved = _grouped(words.hashes, at, new, least & _PLACE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[each[begin]]), pa.array((start[each] + offset)[begin].astype(np.int32)), pa.array(size.astype(np.int32)),
                     pa.array(named[begin].view(np.int64)), pa.array(key.view(np.int64)), pa.array(1 + moved.astype(np.int32))],
                    names=["row", "start", "windows", "name", "key", "n"])

    return split


class Bits(NamedTuple):
    """Bits in words of 64, and the ones before each word."""

    words: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(bit: np.ndarray) -> Bits:
        packed = np.packbits(bit.astype(np.uint8), bitorder="little")
        packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        return Bits(packed, np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))[:-1]]))

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Ones before the places."""
        word = place >> 6
        below = self.words[word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)).astype(np.int64) & 1


def _previous_smaller(values: np.ndarray) -> np.ndarray:
    """Last place before every place that holds a smaller value (0: none)."""
    before = np.maximum(np.arange(len(values)) - 1, 0)
    rows = np.arange(len(values))
    while True:
        rows = rows[(before[rows] > 0) & (values[before[rows]] >= values[rows])]
        if not len(rows):
            return before
        before[rows] = before[before[rows]]


class FMIndex:
    """FM-index of a sequence of symbols (0 ends a piece, the last one too) for matches of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        n, self.depth = len(text), depth
        ranks, width = text.astype(np.int64), 1
        kept = {1: ranks}
        while width == 1 or ranks.max() + 1 < n:
            after = np.zeros(n, dtype=np.int64)
            after[:max(n - width, 0)] = ranks[width:] + 1
            ranks, width = np.unique(ranks * (n + 2) + after, return_inverse=True)[1], 2 * width
            if width <= depth:
                kept[width] = ranks
        suffixes = np.empty(n, dtype=np.int64)
        suffixes[ranks] = np.arange(n)
        # common prefixes of neighbours, from the ranks by their first symbols
        common, above, below = np.zeros(n - 1, dtype=np.int64), suffixes[:-1], suffixes[1:]
        for size in sorted(kept, reverse=True):
            a, b = above + common, below + common
            same = kept[size][np.minimum(a, n - 1)] == kept[size][np.minimum(b, n - 1)]
            common += size * (same & (np.maximum(a, b) < n))
        self.common = np.concatenate([[-1], np.minimum(common, depth), [-1]]).astype(np.int32)
        self.left = _previous_smaller(self.common).astype(np.int32)
        self.right = (n - _previous_smaller(self.common[::-1])[::-1]).astype(np.int32)
        before = np.where(suffixes > 0, text[suffixes - 1], 0)
        # a sample of the places; the first ones of the pieces are in it, so no walk leaves its piece
        sampled = (suffixes % SAMPLE == 0) | (before == 0)
        self.sampled, self.samples = Bits.of(sampled), suffixes[sampled].astype(np.int32)
        self.levels = max(1, int(text.max()).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        self.bits, self.zeros = [], []
        row = before
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            self.bits.append(Bits.of(bit))
            self.zeros.append(int(n - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        # where a symbol's occurrences begin after the last level
        self.shift = self.first[:-1].copy()
        present, begin = np.unique(row, return_index=True)
        self.shift[present] -= begin

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rows before ``place`` that stand for symbol + what the row stands for, as a place (the LF map)."""
        for i, bits in enumerate(self.bits):
            ones = bits.rank(place)
            one = (symbol >> (self.levels - 1 - i)) & 1
            place = np.where(one == 1, self.zeros[i] + ones, place - ones)
        return place + self.shift[symbol]

    def back(self, place: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that begin one symbol earlier."""
        symbol = np.zeros(len(place), dtype=np.int64)
        for i, bits in enumerate(self.bits):
            ones, one = bits.rank(place), bits.at(place)
            place = np.where(one == 1, self.zeros[i] + ones, place - ones)
            symbol = 2 * symbol + one
        return place + self.shift[symbol]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes in these rows."""
        out, at, steps = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), 0
        while len(at):
            known = self.sampled.at(rows) == 1
            out[at[known]] = self.samples[self.sampled.rank(rows[known])] + steps
            at, rows, steps = at[~known], self.back(rows[~known]), steps + 1
        return out

    def matches(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places in the streams text[s:s + size] whose matching statistic reaches ``depth``, and their intervals (low, high).

        The statistic of a place is the length of the longest match with two or more suffixes that begins there;
        streams are read backward, side by side.
        """
        place, low = starts + sizes - 1, np.zeros(len(starts), dtype=np.int64)
        high, length = np.full(len(starts), len(text)), np.zeros(len(starts), dtype=np.int64)
        found: list[tuple[np.ndarray, ...]] = [(low[:0], low[:0], low[:0])]
        while True:
            alive = place >= starts
            if not alive.all():
                starts, place, low, high, length = (x[alive] for x in (starts, place, low, high, length))
            if not len(place):
                return tuple(np.concatenate(x) for x in zip(*found))
            symbol = text[place]
            both = self.step(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            more = both[len(place):] - both[:len(place)] > 1
            # without a second suffix: the parent, which stands for a shorter match
            parent = np.maximum(self.common[low], self.common[high])
            up_low = np.where(self.common[low] == parent, self.left[low], low)
            up_high = np.where(self.common[high] == parent, self.right[high], high)
            low, high = np.where(more, both[:len(place)], up_low), np.where(more, both[len(place):], up_high)
            once = ~more & ((length == 0) | (self.first[symbol + 1] - self.first[symbol] < 2))
            low[once], high[once] = 0, len(text)
            length = np.where(more, np.minimum(length + 1, self.depth), np.where(once, 0, parent))
            full = np.flatnonzero(more & (length == self.depth))
            if len(full):
                deep = full[self.common[low[full]] == self.depth]
                low[deep] = self.left[low[deep]]
                deep = full[self.common[high[full]] == self.depth]
                high[deep] = self.right[high[deep]]
                found.append((place[full], low[full], high[full]))
            place = place - (more | once)

    def search(self, text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals (low, high) of the patterns text[s:s + depth] that more than one suffix begins with, and which they are."""
        place, low, high = self.matches(text, starts, np.full(len(starts), depth))
        order = np.argsort(starts, kind="stable")
        which = order[np.searchsorted(starts[order], place)]
        return which, low, high


def first_windows(row: np.ndarray, start: np.ndarray, windows: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Of all windows of the pieces, one after another: whether it stands at the earliest place of its words."""
    sizes = windows + WINDOW - 1
    hashes = np.frombuffer(b"".join(words), dtype=np.uint64)
    symbols = np.unique(hashes, return_inverse=True)[1] + 1
    # pieces in the order of documents and places, so an earlier place lies earlier in the text
    order = np.lexsort((start, row))
    head = np.empty(len(row), dtype=np.int64)
    head[order] = np.cumsum(sizes[order] + 1) - sizes[order] - 1
    text = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    text[_ranges(head, sizes)] = symbols
    streams = -(-windows // STREAM)
    begin = _ranges(np.zeros(len(row), dtype=np.int64), streams) * STREAM
    owner = np.repeat(np.arange(len(row)), streams)
    index = FMIndex(text, WINDOW)
    found, low, high = index.matches(text, head[owner] + begin, np.minimum(windows[owner] - begin, STREAM) + WINDOW - 1)
    first = np.ones(len(text), dtype=bool)
    if len(found):
        lows, one, inverse = np.unique(low, return_index=True, return_inverse=True)
        reach = high[one] - lows
        places = index.locate(_ranges(lows, reach))
        first[found] = np.minimum.reduceat(places, np.cumsum(reach) - reach)[inverse] == found
    return first[_ranges(head, windows)]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a shard -> (row, kept: starts of the windows that are no repeats)."""
    for table in sorted_groups(batches, ["shard"]):
        row, start, windows = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "start", "windows"))
        first = first_windows(row, start, windows, table.column("words").to_pylist())
        bounds = np.concatenate([[0], np.cumsum(windows)])
        offset = np.arange(bounds[-1]) - np.repeat(bounds[:-1], windows) + np.repeat(start, windows)
        counts = np.add.reduceat(first.astype(np.int64), bounds[:-1])
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        kept = pa.ListArray.from_arrays(offsets, pa.array(offset[first].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(row), kept], names=["row", "kept"])


def _keep_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, pieces, kept) -> id, n_words, n_removed, kept_text, spans."""
    for batch in batches:
        for part in blocks(batch):
            words = words_of(part.column(1))
            n, bounds = part.num_rows, words.bounds
            change = np.zeros(len(words.hashes) + WINDOW + 1, dtype=np.int64)
            listed, kept = part.column(2), part.column(3)
            counts = np.diff(listed.offsets.to_numpy())
            flat = listed.flatten()
            start, windows = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
            head = bounds[:-1][np.repeat(np.arange(n), counts)] + start
            repeat = np.zeros(len(words.hashes) + 1, dtype=bool)
            repeat[np.repeat(head - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))] = True
            firsts = kept.flatten().to_numpy().astype(np.int64)
            repeat[bounds[:-1][np.repeat(np.arange(n), np.diff(kept.offsets.to_numpy()))] + firsts] = False
            at = np.flatnonzero(repeat)
            change[at] += 1
            change[at + WINDOW] -= 1
            stays = np.cumsum(change)[:len(words.hashes)] == 0
            begins, ends = words.begins[stays], words.ends[stays]
            sizes = ends - begins + 1
            reach = np.concatenate([[0], np.cumsum(sizes)])
            source = np.repeat(begins - reach[:-1], sizes) + np.arange(reach[-1])
            data = words.data[np.minimum(source, max(len(words.data) - 1, 0))]
            data[reach[1:] - 1] = 0x20
            left = np.concatenate([[0], np.cumsum(stays)])[bounds]
            raw = data.tobytes()
            texts = [raw[reach[a]:max(reach[b] - 1, reach[a])].decode() for a, b in zip(left[:-1], left[1:])]
            n_words = np.diff(bounds)
            # removed words as intervals, which end with their text at the latest
            gone = np.concatenate([[False], ~stays, [False]])
            edge = np.zeros(len(words.hashes) + 1, dtype=bool)
            edge[bounds] = True
            opens = np.flatnonzero(gone[1:] & (~gone[:-1] | edge))
            closes = np.flatnonzero(gone[:-1] & (~gone[1:] | edge))
            owner = np.searchsorted(bounds, opens, side="right") - 1
            spans = pa.StructArray.from_arrays(
                [pa.array((opens - bounds[owner]).astype(np.int32)), pa.array((closes - bounds[owner]).astype(np.int32))], names=["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(opens, bounds).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words.astype(np.int64)), pa.array((n_words - np.diff(left)).astype(np.int64)),
                 pa.array(texts, pa.string()), spans], names=["id", "n_words", "n_removed", "kept_text", "spans"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """id, n_words, n_removed, kept_text (kept words joined by one space), spans (removed words, end exclusive) of every document."""
    scratch = scratch or Scratch(docs.sparkSession)
    source = keyed(scratch, docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    texts = source.select("row", "text")
    names = scratch.write(texts.mapInArrow(_names, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
                          .filter("n > 1").select("name"))
    listed = texts.mapInArrow(_list_pieces, "row long, start int, windows int, name long, key long")
    listed = scratch.write(listed.join(names, "name", "left_semi"))

    def with_texts(held: DataFrame) -> DataFrame:
        lists = held.groupBy("row").agg(F.collect_list(F.struct("start", "windows", "name")).alias("held"))
        return texts.join(lists, "row").select("row", "text", "held")

    def distinct(table: DataFrame) -> DataFrame:
        first = table.groupBy("name", "key", "windows").agg(F.min(F.struct("row", "start")).alias("first"))
        return scratch.write(first.select("name", "windows", "first.row", "first.start"))

    first = distinct(listed)
    every, calm = [], []
    for run in LONGER_RUNS:
        crowded = scratch.write(first.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED).select("name"))
        if not crowded.take(1):
            break
        every.append(listed.join(crowded, "name", "left_anti"))
        calm.append(first.join(crowded, "name", "left_anti"))
        split = scratch.write(with_texts(listed.join(crowded, "name", "left_semi")).mapInArrow(
            _split(run), "row long, start int, windows int, name long, key long, n int"))
        # a table of its own, so that Spark broadcasts it or splits a name that many pieces have
        again = scratch.write(split.groupBy("name").agg(F.sum("n").alias("n")).filter("n > 1").select("name"))
        listed = scratch.write(split.drop("n").join(again, "name", "left_semi"))
        first = distinct(listed)
    listed, first = reduce(DataFrame.unionByName, every, listed), reduce(DataFrame.unionByName, calm, first)
    size = first.agg(F.sum(F.col("windows") + WINDOW).alias("n")).first()["n"] or 0
    shards = int(size // SHARD_WORDS) + 1
    shard = F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int").alias("shard")
    dealt = with_texts(first).mapInArrow(_cut, "row long, start int, windows int, name long, words binary").select(
        shard, "row", "start", "windows", "words").repartition(shards, "shard").sortWithinPartitions("shard")
    kept = scratch.write(dealt.mapInArrow(_search, "row long, kept array<int>"))
    per_row = kept.groupBy("row").agg(F.flatten(F.collect_list("kept")).alias("kept"))
    per_row = listed.groupBy("row").agg(F.collect_list(F.struct("start", "windows")).alias("pieces")).join(per_row, "row", "left")
    empty = F.expr("cast(array() as array<struct<start:int,windows:int>>)"), F.expr("cast(array() as array<int>)")
    joined = source.join(per_row, "row", "left").select(
        "id", "text", F.coalesce("pieces", empty[0]).alias("pieces"), F.coalesce("kept", empty[1]).alias("kept"))
    id_type = source.schema["id"].dataType.simpleString()
    return joined.mapInArrow(_keep_words, f"id {id_type}, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for (doc_id, text)."""
    return remove_repeats(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
