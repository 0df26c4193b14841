"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until their
marginals are the target shares; every document is then kept with a
probability in proportion to (raked weight / tokens) of its cell, scaled so that
the expected sample has a given share of all tokens.

Native throughout: raking works on the table of cells, never on documents.  It goes on until the weights
stand still; targets that the cells cannot meet together (a source with one language) leave a
miss, which is reported as a warning.

Defined cases: a null category is a category of its own (""); a null or empty
text has no tokens and weighs nothing, its probability is that of its cell, 0 in
a cell without tokens; documents with the same id share their draw; repeated
rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stallworks.llm.tables import Scratch

# Topics by what a text holds, first match wins.
TOPICS = [("short", "length(text) < 400"), ("table", "contains(text, ' | ')"), ("contact", "contains(text, '@')"),
          ("legal", "contains(text, 'icense') or contains(text, 'opyright')")]
OTHER_TOPIC = "prose"
#: shares of a dimension's categories go with (tokens ^ power): 1 keeps the corpus, 0 makes all equal
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: raking ends when a round moves no cell's weight by more than this share of all tokens; a miss of the marginals beyond MISS is reported
TOLERANCE, MISS, MAX_ROUNDS = 1e-6, 1e-4, 500
SHARE = 0.5
SPACES = "[\\x20\\x09-\\x0D]+"


def topic() -> Column:
    """Topic of a row with a column ``text``."""
    return F.expr("case " + " ".join(f"when {test} then '{name}'" for name, test in TOPICS) + f" else '{OTHER_TOPIC}' end")


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACES), lambda w: w != "")).cast("long")


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(category, share): target shares that flatten the corpus by a power."""
    sizes = cells.groupBy(F.col(dimension).alias("category")).agg(F.sum("tokens").alias("t")).filter("t > 0")
    flat = sizes.withColumn("flat", F.pow(F.col("t").cast("double"), F.lit(float(power))))
    total = flat.agg(F.sum("flat").alias("s")).first()["s"] or 1.0
    return flat.select("category", (F.col("flat") / F.lit(total)).alias("share"))


def rake(
    scratch: Scratch, cells: DataFrame, targets: dict[str, DataFrame], rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE,
) -> DataFrame:
    """cells with ``weight``: sums to all tokens, its marginals are the target shares, as far as the cells can meet them.

    Shares are joined to the cells once; a round is then a chain of sums over windows, without joins, so its plan stays small.
    """
    total = float(cells.agg(F.sum("tokens").alias("t")).first()["t"] or 0)
    current = cells.withColumn("weight", F.col("tokens").cast("double"))
    if not total:
        return current
    names = current.columns
    shares = {name: f"share_{i}" for i, name in enumerate(targets)}
    for name, target in targets.items():
        current = current.join(target.select(F.col("category").alias(name), F.col("share").alias(shares[name])), name, "left")
    current = scratch.write(current)
    for _ in range(rounds):
        moved = current.withColumn("before", F.col("weight"))
        for name, share in shares.items():
            moved = moved.withColumn("m", F.sum("weight").over(Window.partitionBy(name)))
            factor = F.when(F.col("m") > 0, F.coalesce(share, F.lit(0.0)) * total / F.col("m")).otherwise(F.lit(0.0))
            moved = moved.withColumn("weight", F.col("weight") * factor).drop("m")
        moved = scratch.write(moved)
        change = moved.agg(F.max(F.abs(F.col("weight") - F.col("before"))).alias("d")).first()["d"] / total
        current = moved.drop("before")
        if change < tolerance:
            return current.select(*names)
    raise RuntimeError(f"weights of the cells still move after {rounds} rounds")


def largest_miss(raked: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest difference between a marginal of the weights and its target, as a share of all tokens."""
    total = raked.agg(F.sum("weight").alias("t")).first()["t"]
    if not total:
        return 0.0
    misses = [raked.groupBy(name).agg(F.sum("weight").alias("m")).join(target.withColumnRenamed("category", name), name, "full").select(
        F.abs(F.coalesce("m", F.lit(0.0)) / total - F.coalesce("share", F.lit(0.0))).alias("miss")) for name, target in targets.items()]
    return reduce(DataFrame.unionByName, misses).agg(F.max("miss").alias("miss")).first()["miss"]


def probabilities(cells: DataFrame, share: float) -> DataFrame:
    """cells with ``ratio`` and ``p`` = min(1, c * ratio), c such that the expected tokens are ``share`` of all.

    Cells that reach 1 leave the rest of the budget to the others, until no further cell gets full.
    """
    cells = cells.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0)))
    budget = share * float(cells.agg(F.sum("tokens").alias("t")).first()["t"] or 0)
    c, settled = share, None
    while True:
        full = F.col("ratio") * c >= 1.0
        s = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(F.lit(0))).alias("full"),
                      F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight"))).alias("rest")).first()
        if not s["rest"] or s["full"] == settled:
            break
        c, settled = max(c, (budget - s["full"]) / s["rest"]), s["full"]
    return cells.withColumn("p", F.least(F.lit(1.0), F.col("ratio") * c))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that only hangs on the key: 52 bits of its MD5."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mixed(
    docs: DataFrame, dimensions: dict[str, Column], tokens: Column, key: Column, carry: dict[str, Column],
    powers: dict[str, float] | None = None, share: float = SHARE, seed: str = "mix:",
) -> DataFrame:
    """The carried columns, the dimensions, ``ratio``, ``p`` and ``kept`` of every row."""
    powers = powers or POWERS
    scratch = Scratch(docs.sparkSession)
    dims = {d: F.coalesce(c.cast("string"), F.lit("")) for d, c in dimensions.items()}
    cells = scratch.write(docs.select(*(c.alias(d) for d, c in dims.items()), tokens.alias("n")).groupBy(*dims).agg(
        F.sum("n").alias("tokens")))
    targets = {d: scratch.write(tempered(cells, d, powers[d])) for d in dims}
    raked = rake(scratch, cells, targets)
    miss = largest_miss(raked, targets)
    if miss > MISS:
        warnings.warn(f"target shares cannot all be met: one is missed by {miss:.6f}", stacklevel=2)
    table = scratch.write(probabilities(raked, share).select(*dims, "ratio", "p"))
    names = {c: f"carried_{c}" for c in carry}
    rows = docs.select(*(c.alias(names[k]) for k, c in carry.items()), *(c.alias(d) for d, c in dims.items()),
                       draw(key, seed).alias("u"))
    done = rows.join(table, list(dims)).withColumn("kept", F.col("u") < F.col("p"))
    return done.select(*(F.col(names[k]).alias(k) for k in carry), *dims, "ratio", "p", "kept")


def mix_sources(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, topic, tokens, ratio, p, kept for (doc_id, text, lang, source); kept rows are the sample."""
    clean = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    slim = Scratch(docs.sparkSession).write(clean.select(
        "doc_id", "lang", "source", topic().alias("topic"), token_count(F.col("text")).alias("tokens")))
    done = mixed(slim, {d: F.col(d) for d in POWERS}, F.col("tokens"), F.col("doc_id"),
                 {"doc_id": F.col("doc_id"), "tokens": F.col("tokens")}, share=share)
    return done.select("doc_id", "topic", "tokens", F.round("ratio", 6).alias("ratio"), F.round("p", 6).alias("p"), "kept")
