"""The index behind substring dedup: against brute force on made-up pieces, and crowded names cut at every level."""

import random

import numpy as np
import pytest

from stallworks.llm import substring_dedup as S


def some_pieces(rng, vocabulary):
    """Distinct pieces of 20 words and more, loose, periodic or holding one another, with row and start."""
    held = {}
    for _ in range(int(rng.integers(1, 12))):
        size = int(rng.integers(20, 220))
        words = rng.integers(0, vocabulary, size)
        if rng.random() < 0.5:
            words = np.tile(words[:3], size)[:size]
        if held and rng.random() < 0.3:
            words = np.concatenate([words[:5], next(iter(held.values())), words[5:]])
        held[tuple(words)] = words
    return list(held.values())


@pytest.mark.parametrize("seed", range(24))
def test_first_windows_are_those_of_brute_force(seed):
    rng = np.random.default_rng(seed)
    pieces = some_pieces(rng, int(rng.integers(2, 6)))
    row, start, free = rng.permutation(len(pieces)) // 2, np.zeros(len(pieces), dtype=np.int64), {}
    for i in rng.permutation(len(pieces)):
        start[i] = free.get(row[i], 0)
        free[row[i]] = start[i] + len(pieces[i]) + 7
    windows = np.array([len(p) - S.WINDOW + 1 for p in pieces])
    places = [((r, s + k), tuple(p[k:k + S.WINDOW])) for r, s, w, p in zip(row, start, windows, pieces) for k in range(w)]
    earliest = {}
    for place, words in places:
        earliest[words] = min(earliest.get(words, place), place)
    found = S.first_windows(row, start, windows, [p.astype(np.uint64).tobytes() for p in pieces])
    assert found.tolist() == [earliest[words] == place for place, words in places]


def test_locate_and_matching_statistics():
    rng = np.random.default_rng(11)
    text = np.concatenate([np.append(rng.integers(1, 4, 70), 0) for _ in range(9)])
    index = S.FMIndex(text, 7)
    places = index.locate(np.arange(len(text)))
    inside = text[places] > 0
    suffixes = sorted(range(len(text)), key=lambda p: text[p:].tolist())
    assert places.tolist() == suffixes and inside.any()
    starts = np.arange(0, len(text), 71)
    found, low, high = index.matches(text, starts, np.full(len(starts), 70))
    runs = [tuple(text[s:s + 7]) for s in range(len(text))]
    whole = [s for s in range(len(text) - 6) if 0 not in runs[s]]
    counts = {s: sum(runs[s] == runs[o] for o in whole) for s in whole}
    assert {int(f): int(h - l) for f, l, h in zip(found, low, high)} == {s: n for s, n in counts.items() if n > 1}
    for f, l, h in zip(found[:20], low, high):
        assert sorted(places[l:h]) == [s for s in whole if runs[s] == runs[f]]


def plain_spans(texts):
    """id -> (kept words, spans of the removed ones), from all windows."""
    seen, out = set(), {}
    for key in sorted(texts):
        words = (texts[key] or "").split()
        gone = [False] * len(words)
        for i in range(len(words) - S.WINDOW + 1):
            run = tuple(words[i:i + S.WINDOW])
            if run in seen:
                gone[i:i + S.WINDOW] = [True] * S.WINDOW
            seen.add(run)
        spans = [i for i in range(len(words) + 1) if (i < len(words) and gone[i]) != (i > 0 and gone[i - 1])]
        out[key] = (" ".join(w for w, g in zip(words, gone) if not g), list(zip(spans[::2], spans[1::2])))
    return out


@pytest.mark.parametrize("crowded", [0, 1, 3, 1024])
def test_names_are_cut_alike_at_every_level(spark, monkeypatch, crowded):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(45)]
    texts = {i: " ".join([*(word() for _ in range(rng.randint(0, 30))), *passage[rng.randint(0, 9):rng.randint(30, 45)],
                          *(word() for _ in range(rng.randint(0, 30)))]) for i in range(40)}
    texts |= {100 + k: "la " * (19 + k) for k in range(8)} | {200: None, 201: "", 202: "tip tap toe " * 60, 203: " ".join(passage)}
    monkeypatch.setattr(S, "CROWDED", crowded)
    monkeypatch.setattr(S, "SHARD_WORDS", 700)
    rows = S.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.id: (r.kept_text, [tuple(s) for s in r.spans]) for r in rows} == plain_spans(texts)
