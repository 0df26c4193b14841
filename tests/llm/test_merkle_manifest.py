"""Merkle manifest against a plain tree, its log, and the defined cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stallworks.llm import merkle_manifest as M


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(leaves):
    """Levels of a ternary tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H("".join(last[i:i + 3])) for i in range(0, len(last), 3)])
    return levels


def proof_of(levels, place):
    steps = []
    for level in levels[:-1]:
        first = place - place % 3
        steps.append(("".join(level[first:place]), "".join(level[place + 1:first + 3])))
        place //= 3
    return steps


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of all rows, sorted."""
    groups = defaultdict(list)
    for row in rows:
        text = row["text"]
        hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0
        bare = text.replace("\n", "") if hit and text is not None else text
        groups[row["source"]].append((row["doc_id"], leaf_of(row, text), leaf_of(row, bare)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[source] = tree([r[1] for r in groups[source]])
    whole = tree([trees[s][-1][0] for s in order])
    out = []
    for k, source in enumerate(order):
        for place, (doc_id, leaf, held) in enumerate(groups[source]):
            steps = proof_of(trees[source], place) + proof_of(whole, k)
            node = held
            for before, after in steps:
                node = H(before + node + after)
            root = whole[-1][0]
            out.append((doc_id, leaf, trees[source][-1][0], root, H("".join(b + a for b, a in steps)), node, node == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, place long, digest string, total long, path string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x", 2, "x") for r in rows], SCHEMA).repartition(5)


def check(spark, rows):
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    assert got(M.audit(documents(spark, rows))) == plain([dict(zip(names, r)) for r in rows])


def test_hot_source_over_several_blocks(spark):
    """A source of more leaves than a block has, sources of one and two, and one row over a full block."""
    rng = random.Random(3)
    rows = [(i, "hot", "en", i, f"line {i}\nsecond" if i % 3 else f"one {i}") for i in range(M.WIDTH * 2 + 5)]
    rows += [(10_000 + i, "edge", None, None, "x\ny") for i in range(M.WIDTH + 1)] + [(20_000, "one", "de", 3, "a\nb"), (20_001, "two", "de", 3, "a"), (20_002, "two", "de", 3, "a")]
    rng.shuffle(rows)
    check(spark, rows)


def test_cases(spark):
    """Null fields, sources and ids, empty and long texts, repeated rows and ids, other alphabets."""
    rows = [(1, None, None, None, None), (None, None, "en", 1, "no id"), (None, "", "en", 1, "no id\n"), (2, "", "en", 0, ""), (2, "", "en", 0, "other\ntext"),
            (3, "b", "en", 1, "same\nrow"), (3, "b", "en", 1, "same\nrow"), (-5, "B", "en", 1, "x"), (4, "é", "fr", 1, "ünï\ncode 😀"),
            (5, "z", "en", 1, "long\n" * 200_000), (2**62, "=", "en", 1, "-")]
    check(spark, rows)
    for one in rows:
        check(spark, [one])


def test_empty_table(spark):
    assert M.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_lost_line_breaks_are_noticed(spark):
    rows = [(i, "s", "en", 1, "a\nb" if i % 5 else "ab") for i in range(100)]
    for row in M.audit(documents(spark, rows)).collect():
        hit = zlib.crc32(str(row.doc_id).encode()) % 2 == 0
        assert row.verified == (not hit or row.doc_id % 5 == 0)
        assert (row.folded_root == row.root) == row.verified


@pytest.mark.parametrize("n", [*range(1, 31), 80, 81, 82, 243, 244])
def test_positions_are_those_of_the_log(n):
    """The closed form finds every node of a log that was built by appending."""
    leaves = [bytes([i % 256, i // 256]) * 16 for i in range(n)]
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([M.hashed(levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    log = M.append(leaves, M.levels_of(n))
    places = {M.position(level, place, n): node for level, nodes in enumerate(levels) for place, node in enumerate(nodes)}
    assert [places[i] for i in range(len(log))] == log and len(places) == len(log)


def test_log_of_a_tree_over_blocks_is_one_postorder(spark):
    """Blocks written by different builders fill one log without gaps, as if one builder had appended all leaves."""
    n = M.WIDTH + 100
    docs = documents(spark, [(i, "s", "en", 1, str(i)) for i in range(n)])
    groups, _, proofs = M.manifest(docs, [F.col("text")], F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id")})
    leaves = [bytes(r.leaf) for r in proofs.orderBy("doc_id").select("leaf").collect()]
    rows = sorted((r.position, bytes(r.digest)) for r in M.log_rows(groups).collect())
    log = M.append(leaves, M.levels_of(n))
    assert [p for p, _ in rows] == list(range(len(log))) and [d for _, d in rows] == log
