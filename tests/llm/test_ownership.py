"""Owners and repositories both decide whether a secret is a widely copied example."""

import pytest
from pyspark.sql import functions as F

from stallworks.llm import secret_scan

KEY = "Zz9-Qq8_Ww7+Rr6/Tt5="


@pytest.mark.parametrize("places, copied", [
    ([("a", "1"), ("a", "2"), ("a", "3"), ("a", "4")], False),  # one owner, however many repositories
    ([("a", "1"), ("b", "2"), ("c", "3")], False),  # three owners, one repository each
    ([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4")], True),
    ([("a", "1"), ("a", "1"), ("b", "1"), ("c", "1"), ("c", "1")], False),  # repositories of one name are told apart by owner: three
    ([("a", "1"), ("b", "1"), (None, "1"), (None, None)], True),  # null is an owner and a repository of its own
])
def test_both_counts_decide(spark, places, copied):
    rows = [(i, f"key {KEY}", owner, repository) for i, (owner, repository) in enumerate(places)]
    df = spark.createDataFrame(rows, "doc_id long, text string, who string, place string")
    found = secret_scan.secret_scan(df, repository=F.col("place"), owner=F.col("who"), min_owners=3, min_repositories=4).collect()
    assert {(r.n_copied, r.n_live, r.n_token) for r in found} == ({(1, 0, 0)} if copied else {(0, 1, 1)})
