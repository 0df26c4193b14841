"""Quality classifier by co-training.

Two views of a document: what its text is made of, and its metadata (language,
source, size).  A logistic regression per view starts from labelled rows; over
some rounds each hands its most confident verdicts on all unlabelled documents
to the other as pseudo-labels.  Both are then calibrated on held-out
labels (Platt) and combined by a last regression on the calibrated views.

All documents are measured in one pass and all are scored.  Every round scores all
unlabelled rows; what it hands over is written, and Newton steps only bring sums of
it to the driver.  Of labelled rows about ``LABELLED`` are drawn by hash of the id,
one in ``HELD_OUT`` of them for calibration.  A class gets about ``PER_ROUND`` of the
unlabelled rows a round, the surest first in steps of 1 / ``STEPS`` of a logit; of those in the last
step a share is drawn by hash of the id.

Defined cases: a null or empty text has zero measures, null metadata are ""; of
several labels of a document the lowest counts and null labels none; without
labels of both kinds every score is 0.5; repeated rows are scored each; a score of exactly the threshold is kept, and ties at
a round's quota are drawn by hash of the id; very long texts are measured whole; only the named columns are read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stallworks.llm.tables import Scratch
from stallworks.llm.words import blocks, words_of

LABELLED, HELD_OUT = 20_000, 4
ROUNDS, PER_ROUND, CONFIDENT = 3, 0.05, 0.9
STEPS = 256
BAG = 32
LANG_BUCKETS, SOURCE_BUCKETS = 8, 16
# Character classes that are counted.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".", b",;:", b"\n", bytes(range(128, 256))]


def text_measures(texts: pa.Array) -> np.ndarray:
    """Sizes, shares of character classes, repetition and a hashed bag of words; one row per text."""
    words = words_of(texts)
    n, bounds = len(texts), words.bounds
    sizes = np.diff(bounds)
    some = np.maximum(sizes, 1)
    lengths = (words.ends - words.begins).astype(np.float64)
    total = np.concatenate([[0.0], np.cumsum(lengths)])
    letters = total[bounds[1:]] - total[bounds[:-1]]
    # a text's bytes from its first to its last word
    first = np.concatenate([words.begins, [len(words.data)]])[np.minimum(bounds[:-1], len(words.begins))]
    last = np.where(sizes > 0, np.concatenate([[0], words.ends])[bounds[1:]], first)
    columns = [np.log1p(sizes), letters / some / 10.0]
    for members in CLASSES:
        table = np.zeros(256, dtype=np.uint8)
        table[list(members)] = 1
        count = np.concatenate([[0], np.cumsum(table[words.data], dtype=np.int64)])
        columns.append((count[last] - count[first]) / np.maximum(letters, 1.0))
    owner = np.repeat(np.arange(n), sizes)
    equal = np.concatenate([words.hashes[1:] == words.hashes[:-1], [False]])[:len(words.hashes)]
    inner = np.ones(len(equal), dtype=bool)
    inner[bounds[1:][sizes > 0] - 1] = False
    columns.append(np.bincount(owner, weights=equal & inner, minlength=n) / some)
    wide = np.bincount(owner * 256 + (words.hashes >> np.uint64(40)).astype(np.int64) % 256, minlength=n * 256).reshape(n, 256)
    share = wide / some[:, None]
    columns += [share.max(axis=1), -(share * np.log(np.maximum(share, 1e-12))).sum(axis=1)]
    bag = wide.reshape(n, BAG, -1).sum(axis=2) / some[:, None]
    return np.concatenate([np.stack(columns, axis=1), np.sqrt(bag)], axis=1).astype(np.float32)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the measures in the place of the text, the last column."""
    for batch in batches:
        for part in blocks(batch):
            values = text_measures(part.column(part.num_columns - 1))
            offsets = pa.array((np.arange(len(values) + 1) * values.shape[1]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*part.schema.names[:-1], "content"])


def metadata_measures(lang: Column, source: Column, n_chars: Column) -> Column:
    size = F.log1p(F.greatest(F.coalesce(n_chars.cast("double"), F.lit(0.0)), F.lit(0.0)))

    def one_hot(value: Column, buckets: int) -> Column:
        bucket = F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit(""))), F.lit(buckets))
        return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: (b == bucket).cast("float"))

    return F.concat(F.array(size.cast("float"), (size * size).cast("float")), one_hot(lang, LANG_BUCKETS), one_hot(source, SOURCE_BUCKETS))


def fit(x: np.ndarray, y: np.ndarray, weight: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps on standardised columns; intercept first, for raw columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1)
    penalty = np.full(z.shape[1], weight)
    penalty[0] = 1e-6
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (y - p) - penalty * beta
        curve = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    raw = beta[1:] / scale
    return np.concatenate([[beta[0] - raw @ mean], raw])


def logits(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(beta[0] + x @ beta[1:], -30, 30)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def totals(rows: DataFrame, measure: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum of a measure (a vector) over all batches; decimals, so that the order of partial sums does not matter."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += measure(batch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["i", "v"])

    sums = rows.mapInArrow(part, "i long, v double").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,12)")).cast("double").alias("v"))
    out = np.zeros(size)
    for i, v in sums.collect():
        out[i] = v
    return out


def _of_pupils(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of each pupil in a batch of (pupil, label, x)."""
    pupil, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    return [(_matrix(batch.column(2).filter(pa.array(pupil == k))), label[pupil == k]) if (pupil == k).any() else None for k in range(2)]


def _newton(z: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    p = 1.0 / (1.0 + np.exp(-np.clip(z @ beta, -30, 30)))
    return np.concatenate([z.T @ (y - p), ((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z).ravel()])


def fit_all(xs: list[np.ndarray], y: np.ndarray, pseudo: DataFrame, weight: float = 1.0, rounds: int = 25) -> list[np.ndarray]:
    """What ``fit`` gives for each pupil over labelled rows and all its rows in (pupil, label, x)."""
    wide = [x.shape[1] for x in xs]

    def both(parts: list[np.ndarray | None], sizes: list[int]) -> np.ndarray:
        return np.concatenate([np.zeros(n) if v is None else v for v, n in zip(parts, sizes)])

    def moments(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    sizes = [2 * w + 1 for w in wide]
    sums = totals(pseudo, lambda b: both([v and moments(v[0]) for v in _of_pupils(b)], sizes), sum(sizes)) + both([moments(x) for x in xs], sizes)
    means, scales, betas = [], [], []
    for w, m in zip(wide, np.split(sums, sizes[:1])):
        mean = m[1:w + 1] / m[0]
        var = m[w + 1:] / m[0] - mean**2
        scale = np.where(var < 1e-12 * (1.0 + mean**2), 1.0, np.sqrt(np.maximum(var, 0.0)))
        means.append(mean)
        scales.append(scale)
        betas.append(np.zeros(w + 1))  # as in fit: full Newton steps may run away from anywhere else

    def design(k: int, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), (x - means[k]) / scales[k]], axis=1)

    sizes = [(w + 1) * (w + 2) for w in wide]
    for _ in range(rounds):
        now = list(betas)
        sums = totals(pseudo, lambda b: both([v and _newton(design(k, v[0]), v[1], now[k]) for k, v in enumerate(_of_pupils(b))], sizes), sum(sizes))
        sums += both([_newton(design(k, x), y, now[k]) for k, x in enumerate(xs)], sizes)
        largest = 0.0
        for k, s in enumerate(np.split(sums, sizes[:1])):
            penalty = np.full(wide[k] + 1, weight)
            penalty[0] = 1e-6
            step = np.linalg.solve(s[wide[k] + 1:].reshape(wide[k] + 1, -1) + np.diag(penalty), s[:wide[k] + 1] - penalty * now[k])
            betas[k] = now[k] + step
            largest = max(largest, np.abs(step).max())
        if largest < 1e-8:
            break
    raw = [b[1:] / s for b, s in zip(betas, scales)]
    return [np.concatenate([[b[0] - r @ m], r]) for b, r, m in zip(betas, raw, means)]


SURE = float(np.log(CONFIDENT / (1.0 - CONFIDENT)))
BINS = 30 * STEPS + 1


def _hits(score: np.ndarray, draw: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Rows that are sure enough: beyond the last step, or in it and drawn; ``cut``: step and share of both classes."""
    hit = np.zeros(len(score), dtype=bool)
    for side, s in enumerate((score, -score)):
        step = np.floor(s * STEPS)
        hit |= (s >= SURE) & ((step > cut[side, 0]) | ((step == cut[side, 0]) & (draw < cut[side, 1])))
    return hit


def _open_scores(batch: pa.RecordBatch, past: list, betas: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(pupil, its teacher's logits, draw) over (content, meta, draw); logits are 0 for rows that the pupil got in a past round."""
    views = [_matrix(batch.column(k)) for k in range(2)]
    draw = batch.column(2).to_numpy(zero_copy_only=False)
    for pupil in range(2):
        x = views[1 - pupil]
        score = logits(betas[1 - pupil], x)
        taken = np.zeros(len(x), dtype=bool)
        for old, cuts in past:
            taken |= _hits(np.where(taken, 0.0, logits(old[1 - pupil], x)), draw, cuts[pupil])
        yield pupil, np.where(taken, 0.0, score), draw


def last_step(counts: np.ndarray, quota: int) -> tuple[float, float]:
    """The step that fills the quota, and the share of its rows that fits, from the number of rows of each step."""
    above = np.concatenate([np.cumsum(counts[::-1])[::-1], [0.0]])
    step = int(np.flatnonzero(above >= quota).max(initial=0))
    return float(step), min(1.0, max(0.0, quota - above[step + 1]) / max(counts[step], 1.0))


def _cuts(spare: DataFrame, past: list, betas: list[np.ndarray], quota: int) -> np.ndarray:
    """Per pupil and class: last step and share."""

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        found = np.zeros((2, 2, BINS))
        for pupil, score, _ in _open_scores(batch, past, betas):
            for side, s in enumerate((score, -score)):
                found[pupil, side] = np.bincount((s[s >= SURE] * STEPS).astype(int), minlength=BINS)
        return found.ravel()

    found = totals(spare, counts, 4 * BINS).reshape(2, 2, BINS)
    return np.array([[last_step(found[pupil, side], quota) for side in range(2)] for pupil in range(2)])


def _handed_over(past: list, betas: list[np.ndarray], cuts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for pupil, score, draw in _open_scores(batch, past, betas):
                hit = _hits(score, draw, cuts[pupil])
                x = batch.column(pupil).filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), pupil, dtype=np.int32)), pa.array((score[hit] > 0).astype(float)), x], names=["pupil", "label", "x"])

    return run


def cotrain(scratch: Scratch, views: list[np.ndarray], y: np.ndarray, spare: DataFrame, held_out: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Coefficients of both calibrated views and of their combination; ``spare``: (content, meta, draw) of all unlabelled rows."""
    train = ~held_out
    xs = [v[train] for v in views]
    betas = [fit(x, y[train]) for x in xs]
    n = spare.count()
    past, pseudo = [], []
    for _ in range(ROUNDS if n else 0):
        cuts = _cuts(spare, past, betas, max(1, int(PER_ROUND * n)))
        pseudo.append(scratch.write(spare.mapInArrow(_handed_over(past, betas, cuts), "pupil int, label double, x array<float>")))
        past.append((betas, cuts))
        betas = fit_all(xs, y[train], reduce(DataFrame.unionByName, pseudo))
    calibrated = []
    for k in range(2):
        platt = fit(logits(betas[k], views[k][held_out])[:, None], y[held_out])
        calibrated.append(np.concatenate([[platt[0] + platt[1] * betas[k][0]], platt[1] * betas[k][1:]]))
    both = np.stack([logits(calibrated[k], views[k][held_out]) for k in range(2)], axis=1)
    last = fit(both, y[held_out])
    if last[1:].min() < 0:  # a view that would count against its own verdict tells nothing: the better one decides
        better = int(np.argmax(last[1:]))
        alone = fit(both[:, better:better + 1], y[held_out])
        last = np.zeros(3)
        last[0], last[1 + better] = alone
    return calibrated, last


def _linear(beta: np.ndarray, x: Column) -> Column:
    weights = F.array(*(F.lit(float(b)) for b in beta[1:]))
    dot = F.aggregate(F.zip_with(x, weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(float(beta[0])) + dot))


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def _sample(df: DataFrame, size: int) -> list[np.ndarray]:
    """About ``size`` rows (all, where there are fewer), drawn by hash of the id: [content, meta, label]."""
    total = df.count()
    share = int(min(1.0, size / max(total, 1)) * 2**30)
    drawn = df.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2**30)) < share).withColumn("place", F.xxhash64("doc_id"))
    rows = drawn.select("place", "content", "meta", "label").toPandas().sort_values("place", kind="stable")
    if rows.empty:
        return [np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0)]
    return [np.stack(rows["content"]).astype(float), np.stack(rows["meta"]).astype(float), rows["label"].to_numpy(dtype=float, na_value=np.nan)]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, meta, content: both views of every document."""
    source = docs.select("doc_id", metadata_measures(F.col("lang"), F.col("source"), F.col("n_chars")).alias("meta"), "text")
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_measure, f"doc_id {id_type}, meta array<float>, content array<float>")


def quality_scores(
    docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, threshold: float = 0.5,
) -> DataFrame:
    """doc_id, p_content, p_meta, p_good, kept for (doc_id, text, lang, source, n_chars) and (doc_id, quality)."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(measured(docs))
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    with_label = rows.join(known, "doc_id")
    content, meta, y = _sample(with_label, labelled)
    held_out = np.arange(len(y)) % HELD_OUT == 0
    if len({*y[held_out]}) < 2 or len({*y[~held_out]}) < 2:
        half = F.lit(0.5)
        return rows.select("doc_id", half.alias("p_content"), half.alias("p_meta"), half.alias("p_good"), F.lit(0.5 >= threshold).alias("kept"))
    unnamed = rows.filter("doc_id is null")
    without = rows.filter("doc_id is not null").join(known, "doc_id", "left_anti").unionByName(unnamed, allowMissingColumns=True)
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2**30)) / F.lit(2.0**30)).alias("draw")
    spare = scratch.write(without.select("content", "meta", draw))
    views, last = cotrain(scratch, [content, meta], y, spare, held_out)
    scored = rows.select("doc_id", _linear(views[0], F.col("content")).alias("a"), _linear(views[1], F.col("meta")).alias("b"))
    good = _sigmoid(F.lit(float(last[0])) + F.lit(float(last[1])) * F.col("a") + F.lit(float(last[2])) * F.col("b"))
    return scored.select(
        "doc_id", F.round(_sigmoid(F.col("a")), 6).alias("p_content"), F.round(_sigmoid(F.col("b")), 6).alias("p_meta"),
        F.round(good, 6).alias("p_good"), (good >= threshold).alias("kept"))
