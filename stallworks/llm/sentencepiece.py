"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text becomes "▁" + text with spaces as "▁"; the segmentation with the highest
sum of log scores wins.  No piece has "▁" after another character, so the
best segmentation of a text is the best of each segment (a run of "▁" and what
follows it).  Each Python task therefore solves every distinct segment once, many
at a time, and looks up the rest.  A character without a piece becomes its UTF-8
bytes as byte pieces.  Of equal scores the one whose last piece is longer wins.

The vocabulary is read once, on the driver, and broadcast: it is of fixed size.

Defined cases: a null or empty text has no pieces and decodes to ""; "▁" in a
text decodes to a space; repeated rows are encoded each; other columns stay as
they are; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: vocabulary file; a parameter of every entry point
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
SEGMENT = re.compile("▁*[^▁]+|▁+")
#: what a character without a piece costs below the worst piece
UNKNOWN_PENALTY = 10.0
#: segments longer than this are solved one by one
LONG = 48
#: distinct segments that a task remembers before it starts anew
REMEMBERED = 250_000


@lru_cache(maxsize=2)
def read_model(path: str) -> dict:
    """pieces, log scores, ids of the 256 byte pieces.

    A merge vocabulary has ranks instead of log scores; by Zipf's law rank r stands for 1 / (r + 2).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    names = [model.id_to_piece(i) for i in range(size)]
    scores = np.array([model.get_score(i) for i in range(size)])
    normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    if all(float(scores[i]).is_integer() for i in normal):
        ranks = np.where(scores > -1e8, -scores, size)
        scores = -np.log(ranks + 2.0) - np.log(np.log(size + 2.0))
    byte_ids = [0] * 256
    for i in range(size):
        if model.is_byte(i):
            byte_ids[int(names[i][3:-1], 16)] = i
    if any(re.search("[^▁]▁", names[i]) for i in normal):
        raise ValueError("a piece has the space marker after another character")
    return {"names": names, "scores": scores, "normal": normal, "byte_ids": np.array(byte_ids, dtype=np.int32)}


def double_array(words: list[str], values: list[int], symbols: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value (-1: no word ends here) of a trie; state 0 is the root, symbol numbers start at 1."""
    root: dict = {}
    for word, value in zip(words, values):
        node = root
        for c in word:
            node = node.setdefault(symbols[c], {})
        node[0] = value
    size = 4 * len(words) + 2 * len(symbols) + 1024
    base, check, ends = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    free, used, stack = 1, 0, [(0, root)]
    while stack:
        state, node = stack.pop()
        if 0 in node:
            ends[state] = node[0]
        labels = np.array(sorted(k for k in node if k), dtype=np.int64)
        if not len(labels):
            continue
        while free < len(check) and check[free] >= 0:
            free += 1
        # a few tries from the first free slot, then behind all used ones
        tries = (free + t - int(labels[0]) for t in range(12))
        at = next((t for t in tries if t > 0 and t + labels[-1] < len(check) and (check[t + labels] < 0).all()), used + 1)
        if at + labels[-1] >= len(check):
            grow = len(check) + int(labels[-1])
            base, check, ends = (np.concatenate([a, np.full(grow, fill, np.int32)]) for a, fill in ((base, 0), (check, -1), (ends, -1)))
        base[state] = at
        check[at + labels] = state
        used = max(used, at + int(labels[-1]))
        stack.extend((at + int(k), node[int(k)]) for k in labels)
    top = int(np.flatnonzero(check >= 0)[-1]) + len(symbols) + 2
    pad = max(0, top - len(check))
    return tuple(np.concatenate([a, np.full(pad, fill, np.int32)])[:top] for a, fill in ((base, 0), (check, -1), (ends, -1)))


@lru_cache(maxsize=2)
def build(path: str = MODEL) -> dict:
    """Everything a task needs to encode and decode."""
    model = read_model(path)
    pieces = [model["names"][i] for i in model["normal"]]
    # frequent characters get small numbers: the children of a state then lie close together
    symbols = {c: k + 1 for k, (c, _) in enumerate(Counter("".join(pieces)).most_common())}
    base, check, ends = double_array(pieces, model["normal"], symbols)
    table = np.zeros(max(map(ord, symbols)) + 1, dtype=np.int32)
    for c, k in symbols.items():
        table[ord(c)] = k
    spelled = [b""] * len(model["names"])
    for i in model["normal"]:
        spelled[i] = model["names"][i].replace(MARK, " ").encode()
    for value, i in enumerate(model["byte_ids"]):
        spelled[i] = bytes([value])
    lengths = np.array([len(s) for s in spelled], dtype=np.int64)
    return {"base": base, "check": check, "ends": ends, "table": table, "scores": model["scores"], "byte_ids": model["byte_ids"],
            "unknown": float(model["scores"][model["normal"]].min() - UNKNOWN_PENALTY),
            "spelled": np.frombuffer(b"".join(spelled), dtype=np.uint8), "lengths": lengths,
            "at": np.concatenate([[0], np.cumsum(lengths)[:-1]])}


def viterbi(m: dict, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece ids of all segments (unknown characters already as bytes), ids per segment, best scores; solved side by side."""
    n, width = len(segments), max(map(len, segments))
    points = np.full((n, width), -1, dtype=np.int64)
    sizes = np.array([len(s) for s in segments])
    flat = np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32)
    points[np.arange(width) < sizes[:, None]] = flat
    codes = np.where((points >= 0) & (points < len(m["table"])), m["table"][np.clip(points, 0, len(m["table"]) - 1)], 0)
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0.0
    came = np.zeros((n, width + 1), dtype=np.int32)
    piece = np.full((n, width + 1), -1, dtype=np.int32)
    base, check, ends, scores = m["base"], m["check"], m["ends"], m["scores"]
    for i in range(width):
        rows = np.flatnonzero(sizes > i)
        single = np.zeros(n, dtype=bool)
        state, alive = np.zeros(len(rows), dtype=np.int64), rows
        for j in range(i, width):
            code = codes[alive, j]
            step = base[state] + code
            go = (code > 0) & (check[step] == state)
            alive, state = alive[go], step[go]
            if not len(alive):
                break
            value = ends[state]
            hit = value >= 0
            r, v = alive[hit], value[hit]
            if j == i:
                single[r] = True
            score = best[r, i] + scores[v]
            better = score > best[r, j + 1]
            r = r[better]
            best[r, j + 1], came[r, j + 1], piece[r, j + 1] = score[better], i, v[better]
        bare = rows[~single[rows]]
        score = best[bare, i] + m["unknown"]
        bare, score = bare[score > best[bare, i + 1]], score[score > best[bare, i + 1]]
        best[bare, i + 1], came[bare, i + 1], piece[bare, i + 1] = score, i, -1
    # all rows walk back at once, one piece per step
    at, steps = sizes.copy(), []
    rows = np.arange(n)
    while len(rows):
        ends_here = at[rows]
        steps.append((rows, piece[rows, ends_here], ends_here))
        at[rows] = came[rows, ends_here]
        rows = rows[at[rows] > 0]
    row = np.concatenate([r for r, _, _ in steps])
    value = np.concatenate([v for _, v, _ in steps])
    end = np.concatenate([e for _, _, e in steps])
    spread = np.ones(len(row), dtype=np.int64)
    bare = np.flatnonzero(value < 0)
    spelled = [m["byte_ids"][list(segments[row[k]][end[k] - 1].encode())] for k in bare]
    spread[bare] = [len(x) for x in spelled]
    order = np.lexsort((end, row))
    place = np.cumsum(spread[order]) - spread[order]
    flat = np.repeat(value[order], spread[order])
    start = np.empty(len(row), dtype=np.int64)
    start[order] = place
    for k, x in zip(bare, spelled):
        flat[start[k]:start[k] + len(x)] = x
    return flat, np.bincount(row, weights=spread, minlength=n).astype(np.int64), best[np.arange(n), sizes]


class Encoder:
    """Encodes texts of one task; remembers the segments it has solved."""

    def __init__(self, model: dict):
        self.m = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.counts, self.starts, self.scores = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def learn(self, keys: list[str]) -> None:
        keys = sorted(keys, key=len)
        short = [MARK + k for k in keys if len(k) < LONG]
        groups = [short[i:i + 8192] for i in range(0, len(short), 8192)] + [[MARK + k] for k in keys[len(short):]]
        solved = [viterbi(self.m, group) for group in groups]
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys))))
        counts = np.concatenate([c for _, c, _ in solved])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, *(f for f, _, _ in solved)])
        self.scores = np.concatenate([self.scores, *(x for _, _, x in solved)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after another, ids per text, score per text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        split = [segment_keys(t) for t in texts]
        keys = list(chain.from_iterable(split))
        fresh = set(keys).difference(self.known)
        if fresh:
            self.learn(list(fresh))
        index = np.fromiter(map(self.known.__getitem__, keys), dtype=np.int64, count=len(keys))
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        sizes = self.counts[index]
        reach = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.starts[index] - reach[:-1], sizes) + np.arange(reach[-1])]
        total = np.concatenate([[0.0], np.cumsum(self.scores[index])])
        return ids, reach[bounds[1:]] - reach[bounds[:-1]], total[bounds[1:]] - total[bounds[:-1]]


def segment_keys(text: str) -> list[str]:
    """Segments of a text, each without its first marker."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [s[1:] for s in SEGMENT.findall(MARK + text.replace(" ", MARK))]


def decode_ids(m: dict, ids: np.ndarray) -> bytes:
    """UTF-8 of a list of ids: pieces with spaces for markers, byte pieces as bytes, without the first space."""
    sizes = m["lengths"][ids]
    reach = np.concatenate([[0], np.cumsum(sizes)])
    data = m["spelled"][np.repeat(m["at"][ids] - reach[:-1], sizes) + np.arange(reach[-1])].tobytes()
    return data[1:] if data[:1] == b" " else data


def _chunks(sizes: list[int], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with few characters each; every text stays whole."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held > limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(
    docs: DataFrame, text: str = "text", model_path: str = MODEL, ids: str = "ids", score: str = "score", decoded: str | None = None,
) -> DataFrame:
    """All columns of ``docs``, then ``ids`` (array<int>), ``score`` (sum of log scores) and, if named, the text decoded from the ids.

    The new names must not clash with the old ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build(model_path))
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(score, T.DoubleType())]
    if decoded is not None:
        fields.append(T.StructField(decoded, T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)  # goes with the task
        for batch in batches:
            column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
            for low, high in _chunks(pc.utf8_length(column).to_pylist()):
                flat, sizes, scores = encoder.encode(column.slice(low, high - low).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                new = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)), pa.array(scores)]
                if decoded is not None:
                    texts = [decode_ids(encoder.m, flat[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
                    new.append(pa.array(texts, pa.string()))
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*batch.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def decode(rows: DataFrame, ids: str = "ids", model_path: str = MODEL, text: str = "decoded") -> DataFrame:
    """All columns of ``rows``, then ``text`` made from ``ids``; bytes that are no UTF-8 become U+FFFD."""
    shared = rows.sparkSession.sparkContext.broadcast(build(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [decode_ids(m, values[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))


def byte_pieces(ids: Column, model_path: str = MODEL) -> Column:
    """How many of the ids are byte pieces."""
    known = [int(i) for i in read_model(model_path)["byte_ids"]]
    return F.size(F.filter(ids, lambda i: i.between(min(known), max(known)))).cast("long")


def encoding_digest(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, n_bytes, ids_sha256 (ids joined by commas), score, round_trip for (doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = encode(rows, model_path=model_path, decoded="decoded")
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), byte_pieces(F.col("ids"), model_path).alias("n_bytes"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.round("score", 4).alias("score"),
        (F.col("decoded") == F.replace("text", F.lit(MARK), F.lit(" "))).alias("round_trip"),
    )
