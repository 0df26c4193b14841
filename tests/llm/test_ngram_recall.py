"""The measured recall of the forest, against plain sets."""

import random
import warnings

import numpy as np
import pyarrow as pa
import pytest

from stallworks.llm import ngram_join
from stallworks.llm.words import grams, words_of



def near_copies(seed, groups, size, length=150, changes=4):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for k in range(size):
            own = list(words)
            for _ in range(rng.randrange(1, changes)):
                own[rng.randrange(length)] = f"x{g}.{k}.{rng.randrange(9)}"
            rows.append((len(rows), " ".join(own)))
    return rows


def plain_shares(rows, similarity):
    """Mean share of partners with a common prefix of 1, 2 ... values, by sets of word runs and plain loops."""
    sets, labels = {}, {}
    for k, text in rows:
        words = text.split()
        sets[k] = {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))}
        shingles, _ = grams(words_of(pa.array([text])), 5)
        labels[k] = ngram_join._labels(shingles, np.zeros(1, np.int64))[0].reshape(ngram_join.TREES, ngram_join.DEPTH).tolist()
    shares = []
    for a in sets:
        reached, partners = [0] * ngram_join.DEPTH, 0
        for b in sets:
            both, joint = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] == sets[b] or both < similarity * joint - 1e-9:
                continue
            partners += 1
            for d in range(ngram_join.DEPTH):
                reached[d] += any(x[:d + 1] == y[:d + 1] for x, y in zip(labels[a], labels[b]))
        if partners:
            shares.append([r / partners for r in reached])
    return [sum(c) / len(shares) for c in zip(*shares)]


def test_recall_is_that_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TREES", 2)
    rows = near_copies(1, 12, 5)
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (902, rows[0][1])], "doc_id long, text string").filter("doc_id <> 902")
    found = ngram_join.measured_recall(df)
    assert found == pytest.approx(plain_shares(rows, 0.8))
    assert found[0] > found[-1] and found[-1] < 1.0


def test_copies_and_lone_texts_need_no_shortening(spark):
    rows = [(i, f"one two three four five {i // 2}") for i in range(8)] + [(20, None)]
    assert ngram_join.measured_recall(spark.createDataFrame(rows, "doc_id long, text string")) == [1.0] * ngram_join.DEPTH
    assert ngram_join.measured_recall(spark.createDataFrame([], "doc_id long, text string")) == [1.0] * ngram_join.DEPTH


def test_prefix_is_shortened_on_the_measured_recall():
    assert ngram_join.prefix_length([1.0] * 6, 0.8, 0.9999) == 4
    assert ngram_join.prefix_length([1.0] * 6, 0.8, 0.9) == 6
    assert ngram_join.prefix_length([1.0, 1.0, 0.9999, 0.99, 0.9, 0.5], 0.8, 0.9999) == 3
    assert ngram_join.prefix_length([0.95, 0.95, 0.95, 0.9, 0.9, 0.5], 0.8, 0.9999) == 3


def test_too_few_trees_are_told(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TREES", 1)
    df = spark.createDataFrame(near_copies(2, 12, 4), "doc_id long, text string")
    assert ngram_join.measured_recall(df)[0] < 1.0
    with pytest.warns(UserWarning, match="prefixes of 1 values"):
        ngram_join.ngram_join(df)


def test_enough_trees_are_silent(spark):
    df = spark.createDataFrame(near_copies(3, 6, 4), "doc_id long, text string")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        found = ngram_join.ngram_join(df).collect()
    assert sum(r.kept for r in found) >= 6 and all(r.class_id <= r.doc_id for r in found)
