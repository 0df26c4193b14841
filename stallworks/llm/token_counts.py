"""Token counts of a text's sections, by offsets.

A document is encoded once, as a whole.  The byte-level vocabulary loses
nothing, so the byte lengths of the tokens give every token's span; the spans
are joined with the spans of the sections (both sorted), and a token that
crosses a boundary goes to one section by a stated rule:

* ``start``: the section that holds its first byte;
* ``end``: the section that holds its last byte;
* ``most``: the section that holds most of its bytes, the earlier one of equals.

Sections are the text's lines, each with the newline that ends it.

Defined cases: a null or empty text has one section without tokens; repeated
rows are documents of their own; a token that crosses a border goes by the rule, and by ``most`` the earlier of equals gets it; very long texts are encoded whole; only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: vocabulary file (base64 token and rank per line); a parameter of every entry point
RANKS = os.environ.get("BYTE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how this vocabulary's words are cut.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "most")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def token_lengths(ranks: dict[bytes, int]) -> np.ndarray:
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    lengths[list(ranks.values())] = [len(t) for t in ranks]
    return lengths


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section number of every token span and whether it crosses a boundary; ``sections`` are sorted starts."""
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    crossing = first != last
    if rule == "end":
        return last, crossing
    chosen = first.copy()
    if rule == "most":
        for k in np.flatnonzero(crossing):
            cuts = np.concatenate([[starts[k]], sections[first[k] + 1:last[k] + 1], [ends[k]]])
            chosen[k] = first[k] + int(np.argmax(np.diff(cuts)))
    return chosen, crossing


def section_counts(texts: pa.Array, encoding, lengths: np.ndarray, rule: str) -> tuple:
    """(sections per text, characters, tokens and crossing tokens per section) of a batch of non-null texts."""
    n_sections, chars, tokens, crossed = [], [], [], []
    for text in texts.to_pylist():
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        cuts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
        ends = np.cumsum(lengths[encoding.encode_to_numpy(text, disallowed_special=())])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        section, crossing = attribute(starts, ends, cuts, rule)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        n_sections.append(len(cuts))
        chars.append(np.diff(heads[np.concatenate([cuts, [len(data)]])]))
        tokens.append(np.bincount(section, minlength=len(cuts)))
        crossed.append(np.bincount(section[crossing], minlength=len(cuts)))
    return n_sections, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (chars, tokens, crossed))


def token_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str = RANKS, rule: str = "start",
) -> DataFrame:
    """doc_id, section (from 0), n_chars (code points), n_tokens, n_crossing; one row per section of every document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks.value, special_tokens={})
        lengths = token_lengths(ranks.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                sections, chars, tokens, crossed = section_counts(part.column(1), encoding, lengths, rule)
                sections = np.array(sections, dtype=np.int64)
                firsts = np.cumsum(sections) - sections
                number = np.arange(sections.sum()) - np.repeat(firsts, sections)
                ids = pc.take(part.column(0), pa.array(np.repeat(np.arange(len(sections)), sections)))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(x.astype(np.int64)) for x in (number, chars, tokens, crossed))],
                    names=["doc_id", "section", "n_chars", "n_tokens", "n_crossing"])

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, section long, n_chars long, n_tokens long, n_crossing long")
