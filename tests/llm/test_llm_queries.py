"""Registered queries of the subpackage at the smallest scale: against their SQL twins, or against plain versions."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, plain
from stallworks.llm import queries as Q, sentencepiece, token_counts

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_all_operators_are_registered():
    assert [int(re.match(r"op(\d+)_", name)[1]) for name in Q.QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_twin(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    result = duck.execute(Q.ORACLES[name])
    columns = [d[0] for d in result.description]
    expected = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert sorted(columns) == order
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == expected


def shingles(text):
    words = WORD.findall(text)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard_classes(texts, similarity=0.8):
    """id -> (links, smallest id of the class), by comparing all pairs that share a shingle."""
    sets = {k: shingles(t) for k, t in texts.items()}
    holders = defaultdict(list)
    for k in sorted(sets):
        for s in sets[k]:
            holders[s].append(k)
    common = defaultdict(int)
    for held in holders.values():
        for j, b in enumerate(held):
            for a in held[:j]:
                common[a, b] += 1
    links, top = defaultdict(int), {k: k for k in sets}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for (a, b), c in common.items():
        if c >= similarity * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            links[a] += 1
            links[b] += 1
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {k: (links[k], find(k)) for k in sets}


def test_ngram_join_finds_what_brute_force_finds(spark, texts):
    found = {r.doc_id: (r.n_links, r.class_id) for r in Q.op6_ngram_join(spark, SF).collect()}
    assert found == jaccard_classes(texts)


def without_repeats(texts, window=20):
    """id -> (words, removed, hash of what is left)."""
    seen, out = set(), {}
    for k in sorted(texts):
        words = WORD.findall(texts[k])
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            run = tuple(words[i:i + window])
            if run in seen:
                gone[i:i + window] = [True] * window
            seen.add(run)
        left = " ".join(w for w, g in zip(words, gone) if not g)
        out[k] = len(words), sum(gone), hashlib.sha256(left.encode()).hexdigest()
    return out


def test_substring_dedup_removes_what_brute_force_removes(spark, texts):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q.op7_substring_dedup(spark, SF).collect()}
    assert found == without_repeats(texts)


def test_token_counts_are_those_of_the_tokens(spark, texts):
    import tiktoken

    ranks = token_counts.read_ranks(token_counts.RANKS)
    encoding = tiktoken.Encoding("own", pat_str=token_counts.WORDS, mergeable_ranks=ranks, special_tokens={})
    spelled = {v: k for k, v in ranks.items()}
    expected = {}
    for k, text in texts.items():
        data, at, counts = text.encode(), 0, defaultdict(int)
        for token in encoding.encode_ordinary(text):
            counts[data[:at].count(b"\n")] += 1
            at += len(spelled[token])
        expected |= {(k, s): counts[s] for s in range(text.count("\n") + 1)}
    found = {(r.doc_id, r.section): r.n_tokens for r in Q.op8_token_counts(spark, SF).collect()}
    assert found == expected


def test_sentencepiece_round_trip_and_best_score(spark, texts):
    rows = Q.op10_sentencepiece(spark, SF).collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)


def test_embedding_components(spark):
    np = pytest.importorskip("numpy")
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    found = {r.vec_id: (r.n_links, r.component_id) for r in Q.op4_embedding_near_dedup(spark, SF).collect()}
    vectors = np.array([r.embedding for r in table], dtype=float)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = np.array([r.label for r in table])
    near = (vectors @ vectors.T >= 0.98) & (labels[:, None] == labels[None, :])
    assert {k: v[0] for k, v in found.items()} == {r.vec_id: int(n) - 1 for r, n in zip(table, near.sum(axis=1))}


def test_classifier_agrees_with_labels(spark):
    scores = {r.doc_id: r.kept for r in Q.op3_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: bool(r.quality) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    right = sum(scores[k] == v for k, v in labels.items() if k in scores)
    assert right >= 0.95 * len(labels)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's rows against a plain version of its decision over the rows of the stage before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], SF).write.parquet(f"{tmp_path}/{k}")
        held.append(spark.read.parquet(f"{tmp_path}/{k}"))
    texts = [{r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()} for df in held[:5]]
    kept = {r.doc_id for r in Q.op2_quality_rules(spark, SF).filter("kept").collect()}
    assert set(texts[1]) == kept
    assert set(texts[2]) == kept and all(set(texts[2][k].split("\n")) <= set(texts[1][k].split("\n")) | {""} for k in kept)
    assert set(texts[3]) == {k for k, (_, top) in jaccard_classes(texts[2]).items() if k == top}
    assert set(texts[4]) <= set(texts[3]) and len(texts[4]) < len(texts[3])
    assert held[5].filter("round_trip").count() == held[5].count() == len(texts[4])
    for df in held[1:5]:
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    encoder = sentencepiece.Encoder(sentencepiece.build())
    digests = {r.doc_id: r.ids_sha256 for r in held[5].collect()}
    for k in sorted(texts[4])[:20]:
        ids, _, _ = encoder.encode([texts[4][k]])
        assert digests[k] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
