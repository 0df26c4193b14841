"""Periodic runs against a plain search, and the defined cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallworks.llm import periodic_runs as P, queries as Q
from stallworks.llm.words import words_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=24, periods=3):
    """All runs (start, length, period), by comparing every word with the one a period later."""
    found = {}
    for p in range(1, len(words) // periods + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, periods * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *row, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
            digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_agrees_with_plain_search(spark):
    short = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r) for r in Q.op12_periodic_runs(spark, SF).collect()}
    assert got.keys() == short.keys()
    assert sum(r[1] for r in got.values()) > 10
    for doc_id, text in short.items():
        assert got[doc_id] == expected(doc_id, text)


def random_words(rng):
    kinds, n = rng.choice([1, 2, 3, 10, 1000]), rng.choice([0, 1, 5, 23, 24, 25, 60, 200, 500])
    words = [str(rng.randrange(kinds)) for _ in range(n)]
    for _ in range(rng.randrange(3) if n else 0):
        a = rng.randrange(n)
        p = rng.randrange(1, max(2, (n - a) // 3 + 1))
        for i in range(a, rng.randrange(a, n + 1)):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("least, periods", [(24, 3), (4, 2), (1, 2)])
def test_random_texts(least, periods):
    rng = random.Random(5)
    for _ in range(15):
        docs = [random_words(rng) for _ in range(20)]
        words = words_of(pa.array([" ".join(d) for d in docs]))
        rows = P.runs_of(words.hashes, words.bounds, least, periods)
        for i, d in enumerate(docs):
            assert [tuple(int(x) for x in r[1:]) for r in rows[rows[:, 0] == i]] == plain_runs(d, least, periods)


def test_extensions_over_many_blocks():
    rng = np.random.default_rng(3)
    words = np.tile(rng.integers(0, 5, 700).astype(np.uint64), 6)
    words[3000] = 9
    reach = P.Extensions(words)
    a, b = rng.integers(0, len(words), 400), rng.integers(0, len(words), 400)
    keep = a != b
    a, b = a[keep], b[keep]
    a[:50], b[:50] = np.arange(50), np.arange(50) + 700
    for x, y, got in zip(a.tolist(), b.tolist(), reach(a, b).tolist()):
        n = 0
        while max(x, y) + n < len(words) and words[x + n] == words[y + n]:
            n += 1
        assert got == n


def test_every_difference_meets_the_cover():
    for d in range(P.STRIDE):
        assert any((c + d) % P.STRIDE in P.COVER for c in P.COVER)


def test_cases(spark):
    rng = random.Random(9)
    long = " ".join(str(rng.randrange(4000)) for _ in range(60_000))
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "a b " * 30), (4, "a b " * 30), (None, "x " * 50), (5, long + " q w e" * 3000), (6, "word " * 23),
             (7, "word x " * 24 + "\r\x0b\x0c end"), (8, "x " * 30 + "y " * 30)]
    docs = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in texts], "doc_id long, text string, runs long, n_words long, carried_0 long")
    rows = P.planted_runs(docs).collect()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        want = expected(doc_id, text) if doc_id != 5 else None
        found = [tuple(r) for r in rows if r.doc_id == doc_id]
        if want:
            assert found == [want] * len(found)
        else:
            assert [(r[1], r[2], r[3], r[4]) for r in found] == [(1, 60_000, 9000, 3)]
    # ties: of two runs with equal shares the earlier one
    assert [r.start for r in rows if r.doc_id == 8] == [0]
    assert P.planted_runs(docs.limit(0)).collect() == []


def test_runs_and_texts_are_real_outputs(spark):
    docs = spark.createDataFrame([(1, "a " + "b c " * 14 + "d")], "doc_id long, text string")
    row = P.periodic_runs(docs, F.col("text"), {"doc_id": F.col("doc_id")}).first()
    assert [tuple(r) for r in row.runs] == [(1, 28, 2)] and row.kept_text == "a b c d" and row.n_words == 30
