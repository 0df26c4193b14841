"""Raking: shares are joined once, rounds hold no joins, and marginals meet their targets."""

from pyspark.sql import functions as F

from stallworks.llm import mixing
from stallworks.llm.tables import Scratch


class Watched(Scratch):
    def __init__(self, spark):
        super().__init__(spark)
        self.plans = []

    def write(self, df):
        self.plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return super().write(df)


def test_rounds_have_no_joins(spark):
    cells = spark.createDataFrame(
        [(s, g, 10 + 7 * i + 3 * j) for i, s in enumerate("abc") for j, g in enumerate("xyz")], "source string, lang string, tokens long")
    scratch = Watched(spark)
    targets = {d: mixing.tempered(cells, d, 0.0) for d in ("source", "lang")}
    raked = mixing.rake(scratch, cells, targets)
    assert len(scratch.plans) > 2
    assert not any("Join" in plan for plan in scratch.plans[1:])
    total = raked.agg(F.sum("tokens")).first()[0]
    for d in targets:
        for r in raked.groupBy(d).agg(F.sum("weight").alias("w")).collect():
            assert abs(r.w / total - 1 / 3) < 1e-4
