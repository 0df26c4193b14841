"""N-gram Jaccard self-join by a MinHash LSH forest.

Every text has one label per tree: ``depth`` MinHash values, four bytes each.
The sorted labels of a tree are its prefix trie; texts under one prefix are
candidates.  The prefix is shortened from the full label on two figures.  The
expected one: a pair of exactly the wanted similarity must be found with the
target recall (at 0.8: four of six values).  The measured one: up to ``AUDITED``
texts, drawn by hash, are compared with every text by their exact shingle sets,
without labels, and the prefix is shortened on as long as the share of true
partners that the forest reaches is below the target and a shorter one reaches
more.  What is still below the target then is raised as a warning.

Candidates whose 8-bit sketches disagree clearly drop out; the rest form groups,
and within a group the shingle sets of all members are compared exactly.  Large
buckets and groups are dealt out as pairs of blocks, links are only counted and
reduced to spanning stars, so no pair is ever a row.

Texts with equal words are one class of copies from the start: they are counted,
not expanded.

Defined cases: shingles are runs of five words; a text of one to four words is
one shingle; a null text or one without words links with nothing; repeated rows
and null or repeated ids are documents of their own (copies of each other), of which the first in the order of ids is kept; a
pair of exactly the wanted similarity is linked; very long texts are hashed whole, in slices of a task's memory; only the named columns
are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stallworks.llm.graph import components
from stallworks.llm.tables import Scratch, keyed
from stallworks.llm.words import blocks, grams, join_labels, mix, sorted_groups, words_of

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH = 20, 6
TARGET_RECALL = 0.9999
#: sketches of a pair of the wanted similarity agree less than this once in many million pairs
SKETCH_FLOOR = 0.55
#: members of a block; a pair of blocks is the largest unit of work
BLOCK = 512
#: texts whose partners are looked for by brute force, and the most shingles of such a text: 8 MB at most
AUDITED, AUDITED_SHINGLES = 256, 4096
_SEEDS = np.random.default_rng(11).integers(1, 2**63, (2, TREES * DEPTH), dtype=np.uint64)


def _labels(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values of each text, whose shingles begin at ``starts``."""
    labels = np.empty((len(starts), TREES * DEPTH), dtype=np.uint32)
    for j in range(TREES * DEPTH):
        values = (shingles ^ _SEEDS[0, j]) * (_SEEDS[1, j] | np.uint64(1))
        labels[:, j] = np.minimum.reduceat(values, starts) >> np.uint64(32)
    return labels


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, key (of the word sequence; null without words), shingles, labels (TREES * DEPTH big-endian uint32)."""
    for batch in batches:
        for part in blocks(batch, limit=1 << 21):
            words = words_of(part.column(1))
            shingles, bounds = grams(words, WORDS)
            n, sizes = part.num_rows, np.diff(bounds)
            full = np.flatnonzero(sizes)
            starts = bounds[:-1][full]
            labels = np.zeros((n, TREES * DEPTH), dtype=np.uint32)
            sequence = np.zeros((n, 2), dtype=np.uint64)
            if len(full):
                labels[full] = _labels(shingles, starts)
                place = (np.arange(len(words.hashes)) - np.repeat(words.bounds[:-1], np.diff(words.bounds))).astype(np.uint64)
                firsts = words.bounds[:-1][full]
                for k in range(2):
                    mixed = mix(words.hashes * np.uint64(2 * k + 3) + mix(place + np.uint64(k + 1)))
                    sequence[full, k] = np.add.reduceat(mixed, firsts)
            keys = [sequence[i].tobytes() if sizes[i] else None for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(keys, pa.binary()), pa.array(sizes.astype(np.int64)),
                 pa.array([x.tobytes() for x in labels.astype(">u4")], pa.binary())],
                names=["row", "key", "shingles", "labels"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets (bucket, low, high, block, row, labels) -> links (a, b) that keep groups of like sketches together."""
    for table in sorted_groups(batches, ["bucket", "low", "high"]):
        bucket, low, high, block, row = (table.column(c).to_numpy() for c in ("bucket", "low", "high", "block", "row"))
        sketch = np.frombuffer(b"".join(table.column("labels").to_pylist()), dtype=np.uint8).reshape(len(row), -1)[:, 3::4]
        least = SKETCH_FLOOR * sketch.shape[1]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        left = np.arange(len(row) - 1)
        step = 1
        while len(left):
            left = left[left + step < len(row)]
            right = left + step
            same = (bucket[left] == bucket[right]) & (low[left] == low[right]) & (high[left] == high[right])
            left, right = left[same], right[same]
            apart = (low[left] == high[left]) | (block[left] != block[right])
            a, b = left[apart], right[apart]
            for at in range(0, len(a), 100_000):
                x, y = a[at:at + 100_000], b[at:at + 100_000]
                like = (sketch[x] == sketch[y]).sum(axis=1) >= least
                found.append((x[like], y[like]))
            step += 1
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
        label = join_labels(len(row), a, b)
        linked = np.flatnonzero(label != np.arange(len(row)))
        yield pa.RecordBatch.from_arrays([pa.array(row[linked]), pa.array(row[label[linked]])], names=["a", "b"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the sorted set of shingles (uint64 bytes) in the place of the text, the last column."""
    for batch in batches:
        for part in blocks(batch):
            values, bounds = grams(words_of(part.column(part.num_columns - 1)), WORDS)
            sets = [np.unique(values[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sets, pa.binary())], names=[*part.schema.names[:-1], "set"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a few sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    owner, column = owner[keep], column[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = max(256, (1 << 22) // max(len(sets), 1))
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), min(width, int(shared.sum()) - at)), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1.0
        total += part @ part.T
    return total.astype(np.int64)


def _verifier(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members (grp, low, high, block, row, copies, set) -> row, label, n (links)."""
        for table in sorted_groups(batches, ["grp", "low", "high"]):
            grp, low, high, block, row, copies = (
                table.column(c).to_numpy() for c in ("grp", "low", "high", "block", "row", "copies"))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("set").to_pylist()]
            cuts = np.flatnonzero(np.concatenate(
                [[True], (grp[1:] != grp[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            out = []
            for s, e in zip(cuts, [*cuts[1:], len(row)]):
                if e - s < 2:
                    continue
                sizes = np.array([len(x) for x in sets[s:e]])
                both = common_counts(sets[s:e])
                joint = sizes[:, None] + sizes[None, :] - both
                link = both >= similarity * joint - 1e-9
                np.fill_diagonal(link, False)
                if low[s] != high[s]:
                    link &= block[s:e, None] != block[None, s:e]
                a, b = np.nonzero(np.triu(link))
                if not len(a):
                    continue
                label = join_labels(e - s, a, b)
                out.append((row[s:e], row[s:e][label], link.astype(np.int64) @ copies[s:e]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], names=["row", "label", "n"])

    return verify


def _dealt(members: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Adds block, low, high: each member takes part in every pair of blocks that holds its own block."""
    blocks_ = F.ceil(F.col(size) / block).cast("int")
    df = members.withColumn("blocks", blocks_).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return df.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")


def recall_at(depth: int, similarity: float, trees: int) -> float:
    return 1.0 - (1.0 - similarity**depth) ** trees


def _auditor(sets: list[np.ndarray], labels: np.ndarray, similarity: float):
    """Compares every text with all audited ones, exactly.

    A partner shares at least ``similarity`` of an audited set, so it holds one of any
    ``1 - similarity`` of its shingles and one more: the rarest of them are looked up,
    and whole sets are compared only where one of these occurs.
    """
    pool, counts = np.unique(np.concatenate(sets), return_counts=True)
    rare = [s[np.argsort(counts[np.searchsorted(pool, s)], kind="stable")][:len(s) - math.ceil(similarity * len(s) - 1e-9) + 1] for s in sets]
    owners = np.repeat(np.arange(len(sets)), [len(r) for r in rare])
    order = np.argsort(np.concatenate(rare), kind="stable")
    values, owners = np.concatenate(rare)[order], owners[order]

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts -> query, reach (values of the longest shared prefix; 0 if sketches disagree), n (partners, copies left out)."""
        for batch in batches:
            for part in blocks(batch):
                shingles, bounds = grams(words_of(part.column(0)), WORDS)
                low, high = np.searchsorted(values, shingles, "left"), np.searchsorted(values, shingles, "right")
                hit = np.flatnonzero(high > low)
                n = (high - low)[hit]
                place = np.repeat(low[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
                texts = np.repeat(np.searchsorted(bounds, hit, "right") - 1, n)
                asked = defaultdict(list)
                for pair in np.unique(texts * len(sets) + owners[place]).tolist():
                    asked[pair // len(sets)].append(pair % len(sets))
                seen: dict[tuple[int, int], int] = defaultdict(int)
                for text, queries in asked.items():
                    own = shingles[bounds[text]:bounds[text + 1]]
                    distinct = np.unique(own)
                    partners = []
                    for q in queries:
                        if min(len(distinct), len(sets[q])) < similarity * max(len(distinct), len(sets[q])) - 1e-9:
                            continue
                        at = np.minimum(np.searchsorted(distinct, sets[q]), len(distinct) - 1)
                        both = int((distinct[at] == sets[q]).sum())
                        joint = len(distinct) + len(sets[q]) - both
                        if both < joint and both >= similarity * joint - 1e-9:
                            partners.append(q)
                    if partners:
                        label = _labels(own, np.zeros(1, np.int64))[0]
                        for q in partners:
                            shared = np.logical_and.accumulate((labels[q] == label).reshape(TREES, DEPTH), axis=1)
                            like = ((labels[q] ^ label) & np.uint32(255) == 0).mean() >= SKETCH_FLOOR
                            seen[q, int(shared.sum(axis=1).max()) if like else 0] += 1
                if seen:
                    columns = zip(*((q, reach, k) for (q, reach), k in seen.items()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "reach", "n"])

    return audit


def _measured(docs: DataFrame, classes: DataFrame, similarity: float) -> list[float]:
    """Mean share of the true partners of audited texts that share a prefix of 1, 2 ... DEPTH values; 1.0 where there are none."""
    drawn = classes.filter(F.col("shingles") <= AUDITED_SHINGLES).orderBy(F.xxhash64("row"), "row").limit(AUDITED)
    drawn = drawn.select("row", "labels").join(docs.select("row", "text"), "row")
    drawn = drawn.mapInArrow(_shingles, "row long, labels binary, set binary").collect()
    if not drawn:
        return [1.0] * DEPTH
    labels = np.array([np.frombuffer(r["labels"], dtype=">u4") for r in drawn]).astype(np.uint32)
    audit = _auditor([np.frombuffer(r["set"], dtype=np.uint64) for r in drawn], labels, similarity)
    seen = docs.select("text").mapInArrow(audit, "query long, reach long, n long").groupBy("query", "reach").agg(F.sum("n").alias("n"))
    partners = np.zeros((len(drawn), DEPTH + 1))
    for r in seen.collect():
        partners[r["query"], r["reach"]] = r["n"]
    partners = partners[partners.sum(axis=1) > 0]
    if not len(partners):
        return [1.0] * DEPTH
    shares = partners[:, ::-1].cumsum(axis=1)[:, ::-1] / partners.sum(axis=1, keepdims=True)
    return shares[:, 1:].mean(axis=0).tolist()


def prefix_length(measured: list[float], similarity: float, recall: float) -> int:
    """The longest prefix with the target recall, as expected at the similarity and as measured for 1, 2 ... values."""
    depth = next((d for d in range(DEPTH, 0, -1) if recall_at(d, similarity, TREES) >= recall), 1)
    while depth > 1 and measured[depth - 1] < min(recall, measured[0]):
        depth -= 1
    return depth


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _candidates(scratch: Scratch, classes: DataFrame, depth: int) -> DataFrame:
    """(node, label) of groups of texts that share a prefix in some tree and have like sketches."""
    width = 4 * DEPTH
    prefix = lambda tree: F.substring("labels", tree * width + 1, F.lit(4 * depth))
    buckets = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda tree: F.xxhash64(tree, prefix(tree)))
    rows = classes.select("row", F.explode(buckets).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = rows.join(sizes, "bucket").join(classes.select("row", "labels"), "row")
    dealt = _dealt(members, "bucket", "n", BLOCK).select("bucket", "low", "high", "block", "row", "labels")
    dealt = dealt.repartition(_partitions(dealt), "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "row")
    return components(scratch, dealt.mapInArrow(_near, "a long, b long"))


def _links(scratch: Scratch, docs: DataFrame, classes: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(row, label, n) over the class representatives of all groups; label is final only within one block."""
    groups = _candidates(scratch, classes, depth)
    tops = groups.select(F.col("label").alias("node")).distinct().withColumn("label", F.col("node"))
    members = groups.union(tops).select(F.col("node").alias("row"), F.col("label").alias("grp"))
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    members = members.join(sizes, "grp").join(classes.select("row", "copies"), "row")
    texts = members.join(docs.select("row", "text"), "row").select("grp", "size", "row", "copies", "text")
    sets = texts.mapInArrow(_shingles, "grp long, size long, row long, copies long, set binary")
    dealt = _dealt(sets, "grp", "size", BLOCK).select("grp", "low", "high", "block", "row", "copies", "set")
    dealt = dealt.repartition(_partitions(dealt), "grp", "low", "high").sortWithinPartitions("grp", "low", "high", "row")
    return scratch.write(dealt.mapInArrow(_verifier(similarity), "row long, label long, n long"))


def _signed(scratch: Scratch, source: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels of all rows, classes of copies, labels of one row a class."""
    signed = scratch.write(source.select("row", "text").mapInArrow(_sign, "row long, key binary, shingles long, labels binary"))
    copies = signed.filter("key is not null").groupBy("key").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies"))
    copies = scratch.write(copies)
    first = signed.join(copies, signed["row"] == copies["first"])
    return signed, copies, scratch.write(first.select("row", "shingles", "labels", "copies"))


def measured_recall(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> list[float]:
    """Recall of the forest with prefixes of 1, 2 ... values, measured by brute force over all documents."""
    scratch = Scratch(docs.sparkSession)
    source = keyed(scratch, docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    return _measured(source, _signed(scratch, source)[2], similarity)


def ngram_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = TARGET_RECALL,
    scratch: Scratch | None = None, carry: list[str] | None = None,
) -> DataFrame:
    """id, carried columns, class_id (smallest id of the class), n_links (documents linked directly), kept; every document."""
    scratch = scratch or Scratch(docs.sparkSession)
    carry = carry or []
    source = keyed(scratch, docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry)))
    signed, copies, classes = _signed(scratch, source)
    measured = _measured(source, classes, similarity)
    depth = prefix_length(measured, similarity, recall)
    if measured[depth - 1] < recall:
        warnings.warn(f"prefixes of {depth} values reach {measured[depth - 1]:.6f} of the true partners, target {recall}", stacklevel=2)
    links = _links(scratch, source, classes, depth, similarity)
    labels = components(scratch, links.select(F.col("row").alias("a"), F.col("label").alias("b")))
    counts = links.groupBy("row").agg(F.sum("n").alias("n"))
    found = counts.join(labels.withColumnRenamed("node", "row"), "row", "left").select("row", "n", F.coalesce("label", "row").alias("label"))
    found = copies.join(found, copies["first"] == found["row"], "left").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "first").alias("label"))
    found = scratch.write(found)
    per_row = signed.select("row", "key").join(found, "key", "left").select(
        "row", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "row").alias("label"))
    per_row = scratch.write(per_row)
    done = source.drop("text") if not carry else source
    done = done.join(per_row, "row")
    names = source.select(F.col("row").alias("label"), F.col("id").alias("class_id"))
    return done.join(names, "label").select(
        "id", *(F.col(f"c_{c}").alias(c) for c in carry), "class_id", "n_links", (F.col("row") == F.col("label")).alias("kept"))


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, kept for (doc_id, text)."""
    return ngram_classes(docs).withColumnRenamed("id", "doc_id")
