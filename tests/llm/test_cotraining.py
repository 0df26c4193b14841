"""Co-training over all unlabelled rows against a plain version that holds everything in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallworks.llm import quality_classifier as C
from stallworks.llm.tables import Scratch

SF = "/root/testdata/sf0.01"


def plain_cotrain(views, y, pools, draw, held_out):
    """The rounds of co-training with whole arrays and sorted scores."""
    train = ~held_out
    xs, ys = [[v[train]] for v in views], [[y[train]] for _ in views]
    betas = [C.fit(x[0], y[train]) for x in xs]
    taken = [np.zeros(len(draw), dtype=bool) for _ in views]
    quota = max(1, int(C.PER_ROUND * len(draw)))
    for _ in range(C.ROUNDS):
        for pupil in range(2):
            score = C.logits(betas[1 - pupil], pools[1 - pupil])
            given = np.zeros(len(draw), dtype=bool)
            for label, s in ((1.0, score), (0.0, -score)):
                sure = np.flatnonzero(~taken[pupil] & (s >= C.SURE))
                step = np.floor(s[sure] * C.STEPS)
                order = np.sort(step)[::-1]
                if len(order) > quota:
                    last = order[quota - 1]
                    share = (quota - (step > last).sum()) / (step == last).sum()
                    sure = sure[(step > last) | ((step == last) & (draw[sure] < share))]
                xs[pupil].append(pools[pupil][sure])
                ys[pupil].append(np.full(len(sure), label))
                given[sure] = True
            taken[pupil] |= given
        betas = [C.fit(np.concatenate(xs[k]), np.concatenate(ys[k])) for k in range(2)]
    return betas


@pytest.fixture(scope="module")
def rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    both = C.measured(docs).join(labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id", "left")
    both = both.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2**30)) / F.lit(2.0**30))
    return both.orderBy("doc_id").toPandas()


def test_rounds_agree_with_plain_version(spark, rows):
    matrix = lambda part, c: np.stack(part[c]).astype(float)
    known, spare = rows[rows.label.notna()], rows[rows.label.isna()]
    views, y = [matrix(known, "content"), matrix(known, "meta")], known.label.to_numpy()
    held_out = np.arange(len(y)) % C.HELD_OUT == 0
    table = spark.createDataFrame([(r.content.tolist(), r.meta.tolist(), r.draw) for r in spare.itertuples()], "content array<float>, meta array<float>, draw double")
    scratch = Scratch(spark)
    calibrated, _ = C.cotrain(scratch, views, y, scratch.write(table.repartition(7)), held_out)
    betas = plain_cotrain(views, y, [matrix(spare, "content"), matrix(spare, "meta")], spare.draw.to_numpy(), held_out)
    for k in range(2):
        platt = C.fit(C.logits(betas[k], views[k][held_out])[:, None], y[held_out])
        want = np.concatenate([[platt[0] + platt[1] * betas[k][0]], platt[1] * betas[k][1:]])
        assert np.abs(calibrated[k] - want).max() <= 1e-6 * max(1.0, np.abs(want).max())


def test_sums_over_tables_fit_like_arrays(spark, rows):
    known = rows[rows.label.notna()]
    x = [np.stack(known[c]).astype(float) for c in ("content", "meta")]
    y = known.label.to_numpy()
    half = np.arange(len(y)) % 2 == 0
    given = [(k, float(label), v.tolist()) for k, c in enumerate(("content", "meta")) for v, label in zip(known[c][~half], y[~half])]
    pseudo = spark.createDataFrame(given, "pupil int, label double, x array<float>").repartition(5)
    fitted = C.fit_all([v[half] for v in x], y[half], pseudo)
    for k in range(2):
        want = C.fit(np.concatenate([x[k][half], x[k][~half]]), np.concatenate([y[half], y[~half]]))
        assert np.abs(fitted[k] - want).max() <= 1e-6 * max(1.0, np.abs(want).max())


@pytest.mark.parametrize("counts, quota, want", [
    ([0, 0, 5, 3], 4, (2.0, 0.2)), ([0, 0, 5, 3], 3, (3.0, 1.0)), ([0, 0, 0, 9], 3, (3.0, 1 / 3)), ([0, 1, 0, 0], 5, (0.0, 1.0)), ([0, 0, 0, 0], 5, (0.0, 1.0))])
def test_quota_ends_inside_a_step(counts, quota, want):
    """Ties at the quota are drawn by hash, not all taken; a quota that is not reached takes all that are sure."""
    assert C.last_step(np.array(counts, dtype=float), quota) == pytest.approx(want)
