"""Secret scan with corpus-wide ownership frequency.

One pass finds candidate secrets in every text.  Their hashes are then counted
over the whole corpus by distinct repository and owner: a value that many
owners hold, in more repositories still, is a widely copied example; a value that stays with few owners, however
many repositories of theirs hold it, and looks random is a live credential of theirs.

Defined cases: a null text is empty; a null repository or owner is one of its
own (""); repeated rows and repeated or null ids are documents of their own; texts of any length are scanned whole;
of findings that start at one place the kind listed first comes first; further columns of any name are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stallworks.llm.tables import Scratch

# The kinds and their patterns, in the order that ties of a start are listed in.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "token")
BASE_KINDS = 3
MIN_ASSIGN, MIN_ACCESS = 6, 20
KEYWORD_PARTS = ("passw", "secret", "token", "api")

FINDING = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()),
                     ("live", pa.bool_())])
FINDING_SQL = "array<struct<kind:int,start:int,end:int,hash:string,live:boolean>>"


def looks_live(value: str, min_entropy: float = 3.0) -> bool:
    """Letters and digits mixed, with the spread of characters that random values have."""
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= min_entropy


def findings(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of one text: all base findings, then tokens that overlap none of them."""
    found = []
    lowered = text.lower()
    if any(part in lowered for part in KEYWORD_PARTS):
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    # the leftmost run of 24 or more is the whole run
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((start, end) for _, start, end, _ in found)
    at, reach = 0, -1
    for m in TOKEN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][1])
            at += 1
        if reach <= m.start() and looks_live(m[0]):
            found.append((3, m.start(), m.end(), m[0]))
    return sorted(found, key=lambda f: (f[1], f[0]))


def span_text(found: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end, _ in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, hashes, bases, lists = ([], [], []), [], [], []
        for text in batch.column(batch.schema.get_field_index("text")):
            found = findings(text.as_py() or "")
            base = [f for f in found if f[0] < BASE_KINDS]
            for kind in range(BASE_KINDS):
                counts[kind].append(sum(f[0] == kind for f in base))
            bases.append(span_text(base))
            hashes.append(hashlib.sha256(bases[-1].encode()).hexdigest())
            lists.append([{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest(),
                           "live": looks_live(v)} for k, s, e, v in found])
        keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "repository", "owner")]
        yield pa.RecordBatch.from_arrays(
            [*keep, *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()),
             pa.array(bases, pa.string()), pa.array(lists, pa.list_(FINDING))],
            names=["doc_id", "repository", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "base_spans", "found"],
        )


def secret_findings(scratch: Scratch, docs: DataFrame, doc_id: str, text: str, repository: Column, owner: Column) -> DataFrame:
    """One written row per document: base counts and spans, and all candidates."""
    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.col(text).alias("text"),
    )
    id_type = source.schema["doc_id"].dataType.simpleString()
    scanned = source.mapInArrow(
        _scan, f"doc_id {id_type}, repository string, owner string, n_assign long, n_access long, n_hex long, "
        f"base_sha256 string, base_spans string, found {FINDING_SQL}",
    )
    return scratch.write(scanned.withColumn("row", F.monotonically_increasing_id()))


def ownership(found: DataFrame, min_owners: int, min_repositories: int) -> DataFrame:
    """hash -> numbers of distinct owners and repositories, and whether it is a widely copied example."""
    places = found.select("owner", "repository", F.explode("found.hash").alias("hash")).distinct()
    by_owner = places.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"),
    ).withColumn("widely_copied", (F.col("n_owners") >= min_owners) & (F.col("n_repositories") >= min_repositories))


def secret_scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: Column | None = None,
    owner: Column | None = None, min_owners: int = 3, min_repositories: int = 3,
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token, n_live, n_copied; one row per document.

    ``spans`` holds every base span and, as ``token``, further random-looking
    values that are not widely copied.  ``n_live`` counts findings that look random and are not widely copied,
    ``n_copied`` findings whose value at least ``min_owners`` owners hold in at least ``min_repositories`` repositories.
    The source is the owner, and its only repository, where no others are given.
    """
    scratch = Scratch(docs.sparkSession)
    owner = F.col("source") if owner is None else owner
    repository = owner if repository is None else repository
    rows = secret_findings(scratch, docs, doc_id, text, repository, owner)
    held = scratch.write(ownership(rows, min_owners, min_repositories).select("hash", "widely_copied"))
    each = rows.select("row", F.explode("found").alias("f")).select("row", "f.*").join(held, "hash")
    listed = (F.col("kind") < BASE_KINDS) | ~F.col("widely_copied")
    names = F.array(*(F.lit(k) for k in KINDS))
    per_row = each.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(listed, F.struct("start", "kind", "end")))).alias("kept"),
        F.count_if(listed & (F.col("kind") == BASE_KINDS)).alias("n_token"),
        F.count_if(F.col("live") & ~F.col("widely_copied")).alias("n_live"),
        F.count_if(F.col("widely_copied")).alias("n_copied"),
    ).withColumn("spans", F.array_join(F.transform("kept", lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_token", "n_live", "n_copied")}
    return rows.join(per_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), *zero.values(),
    )
