"""Merkle manifest of a dataset: a ternary tree per group, a tree over the groups, a proof for every row.

Every row is a leaf, the digest of its fields.  The leaves of a group ascend by key; ``ARITY``
neighbours become their parent (the last ones of a level may be fewer, even one) until
one node is left.  The tops of the groups are in turn the leaves of the tree whose top is the root.

The log of a tree holds its nodes in postorder, the order in which they are completed when
leaves are appended.  Leaves are dealt to aligned blocks of ARITY ** ``HEIGHT``: one builder
per block appends them and writes each node as soon as its children are there.  The tops
of the blocks are dealt and built in the same way until a tree has one block, so a group of
any size is built in as many tasks as it has blocks.  Where a node lies in a log follows from its level and its
place alone (``position``), so a proof reads its siblings from the block's log without any search
or pointer.  Proofs go down the same way: a block gets the proof of its top, and puts the steps inside itself before it.

Leaves are numbered by a sort over ranges of (group, key); only one count per range and group is summed in order.
Equal rows are split by a row number, so a hot key does not gather.

Defined cases: a null field is hashed as ``-``; a null group comes before all others, then groups ascend by UTF-8 bytes; null
keys come first; rows of one key ascend by their leaf, equal leaves in any order, and every one is a leaf of its own; a group of one row is its own top;
with one group the root is its top; texts of any length are hashed whole; only the named columns are read; an empty table has no leaves
and no root, and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stallworks.llm.tables import Scratch

ARITY, HEIGHT = 3, 6
WIDTH = ARITY**HEIGHT
SIZE = 32
PATH = "array<struct<left:binary,right:binary>>"
#: carried beside every proof: top of its tree, root of all
ENDS = ["top", "root"]


def digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields, each with its length in bytes before it, so that no two rows read alike."""
    parts = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f))
             for f in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*parts), 256)


def hashed(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def levels_of(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n = -(-n // ARITY)
        levels += 1
    return levels


def position(level: int, place: int, n: int) -> int:
    """Where the log of n leaves holds a node: nodes completed before its first leaf, then its subtree, whose last node it is."""
    first, beyond = place * ARITY**level, (place + 1) * ARITY**level
    before, subtree = 0, 0
    power = 1
    while power <= first:
        before += first // power
        power *= ARITY
    for below in range(level + 1):
        power = ARITY**below
        subtree += min(-(-n // power), beyond // power) - first // power
    return before + subtree - 1


def append(leaves: list[bytes], levels: int) -> list[bytes]:
    """The postorder log of a tree, built by appending leaves."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def put(level: int, node: bytes) -> None:
        log.append(node)
        if level < levels:
            waiting[level].append(node)
            if len(waiting[level]) == ARITY:
                close(level)

    def close(level: int) -> None:
        children, waiting[level] = waiting[level], []
        put(level + 1, hashed(children))

    for leaf in leaves:
        put(0, leaf)
    for level in range(levels):
        if waiting[level]:
            close(level)
    return log


def block_levels(total: int) -> int:
    """Levels that a block of a tree builds: all of them in the tree's only block."""
    return HEIGHT if total > WIDTH else levels_of(total)


def steps(log: bytes, n: int, levels: int, above: list[dict]) -> list[list[dict]]:
    """Proofs of the n leaves of a block: per step the siblings to the left and to the right, up to the root."""
    paths = [above]
    for level in range(levels - 1, -1, -1):
        count = -(-n // ARITY**level)
        at = [position(level, place, n) * SIZE for place in range(count)]
        nodes = [log[i:i + SIZE] for i in at]
        lower = []
        for place in range(count):
            first = place - place % ARITY
            step = {"left": b"".join(nodes[first:place]), "right": b"".join(nodes[place + 1:first + ARITY])}
            lower.append([step, *paths[place // ARITY]])
        paths = lower
    return paths


def numbered(scratch: Scratch, rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``place`` (from 0 in the order, per tree) and ``total`` (rows of the tree) to a written table."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(tree, *order, "tie").sortWithinPartitions(tree, *order, "tie")
    ranged = scratch.write(ranged.drop("tie").withColumn("at", F.monotonically_increasing_id()))
    chunk = F.shiftright("at", 33).alias("chunk")
    sizes = ranged.groupBy(tree, chunk).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(tree).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(tree, "chunk", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
                           F.sum("n").over(Window.partitionBy(tree)).alias("total"))
    found = ranged.withColumn("chunk", chunk).join(offsets, [tree, "chunk"])
    return found.withColumn("place", F.col("offset") + F.col("at") - F.col("first")).drop("offset", "at", "first", "chunk")


class Log(NamedTuple):
    nodes: DataFrame  #: (tree, place, total, digest, ...): the leaves
    passes: list[DataFrame]  #: (tree, total, block, n, log): logs of the blocks, the leaves of a pass being the tops of the last


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("place")
    total = table.column("total")[0].as_py()
    log = append(table.column("digest").to_pylist(), block_levels(total))
    return pa.table({
        "tree": [table.column("tree")[0].as_py()], "total": [total], "block": [table.column("block")[0].as_py()], "n": [table.num_rows],
        "log": pa.array([b"".join(log)], pa.binary()),
    })


def _block(place: str = "place") -> Column:
    return F.floor(F.col(place) / F.lit(WIDTH)).cast("long").alias("block")


def build(scratch: Scratch, nodes: DataFrame) -> Log:
    """Logs of all trees of (tree, place, total, digest)."""
    passes: list[DataFrame] = []
    level = nodes
    while True:
        work = level.select("tree", "total", _block(), "place", "digest").groupBy("tree", "block")
        blocks = scratch.write(work.applyInArrow(_build, "tree string, total long, block long, n long, log binary"))
        passes.append(blocks)
        wide = blocks.filter(F.col("total") > WIDTH)
        if not wide.limit(1).count():
            return Log(nodes, passes)
        level = wide.select("tree", F.col("block").alias("place"), F.ceil(F.col("total") / WIDTH).cast("long").alias("total"), _top().alias("digest"))


def _top() -> Column:
    return F.substring("log", -SIZE, SIZE)


def tops(log: Log) -> DataFrame:
    """(tree, digest): the top of every tree."""
    done = [p.filter(F.col("total") <= WIDTH).select("tree", _top().alias("digest")) for p in log.passes]
    return _union(done)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def _path_type() -> pa.DataType:
    return pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def _inner(blocks: pa.Table) -> pa.Table:
    """Proofs of the leaves of one block that is itself inside a tree."""
    row = blocks.slice(0, 1).to_pylist()[0]
    paths = steps(row["log"], row["n"], block_levels(row["total"]), row["path"])
    base = row["block"] * WIDTH
    n = len(paths)
    return pa.table({"tree": [row["tree"]] * n, "block": pa.array(range(base, base + n), pa.int64()), "path": pa.array(paths, _path_type()),
                     **{c: pa.array([row[c]] * n, pa.binary()) for c in ENDS}})


def prove(scratch: Scratch, log: Log, above: DataFrame, carry: list[str]) -> DataFrame:
    """(tree, digest, path, top, root) and the carried columns of every leaf; ``above``: (tree, path, top, root) of the trees' tops."""
    ready = None
    for depth in range(len(log.passes) - 1, -1, -1):
        blocks = log.passes[depth]
        here = blocks.filter(F.col("total") <= WIDTH).join(above, "tree")
        if ready is not None:
            here = here.unionByName(blocks.filter(F.col("total") > WIDTH).join(ready, ["tree", "block"]))
        if depth:
            ready = scratch.write(here.groupBy("tree", "block").applyInArrow(_inner, f"tree string, block long, path {PATH}, top binary, root binary"))
    leaves = log.nodes.select("tree", _block(), "place", "digest", *carry)

    def last(nodes: pa.Table, blocks: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("place")
        row = blocks.slice(0, 1).to_pylist()[0]
        paths = steps(row["log"], row["n"], block_levels(row["total"]), row["path"])
        columns = {c: nodes.column(c) for c in ("tree", "digest", *carry)}
        return pa.table({**columns, "path": pa.array(paths, _path_type()), **{c: pa.array([row[c]] * nodes.num_rows, pa.binary()) for c in ENDS}})

    types = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    schema = ", ".join([*(f"{c} {types[c]}" for c in ("tree", "digest", *carry)), f"path {PATH}", "top binary", "root binary"])
    return leaves.groupBy("tree", "block").cogroup(here.groupBy("tree", "block")).applyInArrow(last, schema)


def manifest(df: DataFrame, fields: list[Column], group: Column, key: Column, carry: dict[str, Column]) -> tuple[Log, Log, DataFrame]:
    """Log of the groups, log of the root's tree, and the proof of every row.

    The last table has the carried columns (small ones), ``leaf``, ``top``, ``root`` (binary) and ``path``, the
    siblings to the left and right of every step from the leaf to the root.
    """
    scratch = Scratch(df.sparkSession)
    names = {c: f"carried_{i}" for i, c in enumerate(carry)}
    # "=" keeps an empty group apart from a null one, and behind it
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("tree")
    leaves = scratch.write(df.select(tree, key.alias("key"), F.unhex(digest(fields)).alias("digest"), *(c.alias(names[k]) for k, c in carry.items())))
    nodes = scratch.write(numbered(scratch, leaves, "tree", ["key", "digest"]).drop("key"))
    groups = build(scratch, nodes)
    subroots = scratch.write(tops(groups).select(F.lit("").alias("one"), F.col("tree").alias("name"), "digest"))
    named = numbered(scratch, subroots, "one", ["name"]).withColumnRenamed("one", "tree")
    whole = build(scratch, scratch.write(named))
    no_path = F.array().cast(PATH).alias("path")
    summit = tops(whole).select("tree", no_path, F.col("digest").alias("top"), F.col("digest").alias("root"))
    above = scratch.write(prove(scratch, whole, summit, ["name"]).select(F.col("name").alias("tree"), "path", "root", F.col("digest").alias("top")))
    proofs = prove(scratch, groups, above, list(names.values()))
    return groups, whole, proofs.select(*(F.col(v).alias(k) for k, v in names.items()), F.col("digest").alias("leaf"), "top", "root", "path")


def log_rows(log: Log) -> DataFrame:
    """(tree, position, digest): every node once, at its place in the tree's whole log."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels, found = block_levels(row["total"]), []
                for level in range(0 if row["depth"] == 0 else 1, levels + 1):
                    for place in range(-(-row["n"] // ARITY**level)):
                        at = position(level, place, row["n"]) * SIZE
                        whole = position(level + row["depth"] * HEIGHT, row["block"] * ARITY**(HEIGHT - level) + place, row["leaves"])
                        found.append((whole, row["log"][at:at + SIZE]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * len(found)), pa.array([p for p, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())],
                    names=["tree", "position", "digest"])

    leaves = log.passes[0].groupBy("tree").agg(F.max("total").alias("leaves"))
    each = [p.withColumn("depth", F.lit(i)) for i, p in enumerate(log.passes)]
    return _union(each).join(leaves, "tree").mapInArrow(rows, "tree string, position long, digest binary")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and its proof lead to."""
    text = lambda siblings: F.lower(F.hex(siblings))
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(text(step["left"]), node, text(step["right"])), 256))


def proof_digest(path: Column) -> Column:
    """Hex SHA-256 of all siblings of a proof, as hex text, from the leaf up."""
    return F.sha2(F.lower(F.array_join(F.transform(path, lambda s: F.concat(F.hex(s["left"]), F.hex(s["right"]))), "")), 256)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def audit(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, checked against copies of which half (by CRC-32 of the id) lost their line breaks."""
    fields = {c: F.col(c) for c in FIELDS}
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    tampered = F.when(hit, F.unhex(digest([*(fields[c] for c in FIELDS[:-1]), F.translate("text", "\n", "")])))
    _, _, proofs = manifest(docs, list(fields.values()), fields["source"], fields["doc_id"], {"doc_id": fields["doc_id"], "tampered": tampered})
    hexed = lambda c: F.lower(F.hex(c))
    again = proofs.withColumn("folded_root", folded(hexed(F.coalesce("tampered", "leaf")), F.col("path")))
    return again.select(
        "doc_id", hexed("leaf").alias("leaf"), hexed("top").alias("subroot"), hexed("root").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == hexed("root")).alias("verified"))
