"""Words of many texts at once, as 64-bit hashes, with NumPy inside a task.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r.  Its hash is a
sum of random numbers per byte value and place, mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 2**64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(step: int, n: int) -> np.ndarray:
    steps = np.full(n, step, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class Words(NamedTuple):
    hashes: np.ndarray  #: of all words, one text after another
    begins: np.ndarray  #: byte offsets in ``data``
    ends: np.ndarray
    bounds: np.ndarray  #: words of text i are bounds[i]:bounds[i + 1]
    data: np.ndarray  #: bytes of all texts


def words_of(texts: pa.Array) -> Words:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    word = ~_SPACE[data]
    heads = np.zeros(n + 1, dtype=bool)
    heads[offsets] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | heads[1:n]
    end[:-1] &= ~word[1:] | heads[1:n]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _powers(_STEP, n), _powers(_BACK, n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up)])
    hashes = mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    return Words(hashes, begins, ends, np.searchsorted(begins, offsets), data)


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with few bytes of text each; every text stays whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    low, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += size
    if low < batch.num_rows:
        yield batch.slice(low)


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that lie in one text, and bounds per text; a text of 1 to k - 1 words is one run."""
    h, n = words.hashes, len(words.hashes)
    sizes = np.diff(words.bounds)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(words.bounds[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    reach = np.repeat(words.bounds[1:], counts)
    out = np.zeros(bounds[-1], dtype=np.uint64)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(k):
        out = out * np.uint64(_STEP) + np.where(first + j < reach, padded[first + j], np.uint64(j + 1))
    return mix(out), bounds


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches in which the rows of a group follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for key in keys:
            column = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
            if held:
                last = held[-1].column(held[-1].schema.get_field_index(key))
                change[0] |= last[len(last) - 1].as_py() != column[0]
        cuts = np.flatnonzero(change)
        if len(cuts):
            if cuts[-1] or held:
                yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))]) if cuts[-1] else pa.Table.from_batches(held)
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def join_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from every one of n nodes by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
