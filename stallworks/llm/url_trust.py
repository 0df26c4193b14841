"""URL filter: rules decide first, trust and distrust that spread over the graph of hosts decide the rest.

A rule (host, path) fits its host and all subdomains of it, if the url's path starts with the
rule's; the longest rule that fits wins (of equally long ones the one with the longer host).

Hosts are linked by the hyperlinks of their pages that lead to other hosts (weight: pages that link), and every host
is linked to its parent domains down to two labels (weight 1).  Trust is a personalised PageRank: a host
starts with the share of its pages that rules allow, and hands ``DAMPING`` of what it gets on over its
links in proportion to their weights.  Distrust starts with the share that rules block and goes
backwards, from a host to those that link to it.  Both are sums of series, in whole
millionths (``UNIT``) with every share cut to a whole number: each round hands on what the round before
brought, until nothing is left, so the result is exact, the same in any order of
summation, and the rounds end by themselves.  A host whose distrust exceeds its trust by ``THRESHOLD`` is blocked, others are allowed.

Native throughout.  Hosts and links are tables; a round joins only the hosts that got something.  Links of a
hub are dealt to slices of ``SLICE``, what it hands on is copied to its slices, and sums are partial before the shuffle.
Pages meet their host's scores in a join over short rows, broadcast only below Spark's size limit, else split by AQE.

Defined cases: a null url or one without ``://`` has host and path "" and no rule, and its host no links, no scores and the verdict allow;
null or empty html has no links; a link counts once per page; links to the own host count nothing; repeated rows are pages of their own;
hosts without pages pass trust on only to parents that pages' hosts name; a tie of trust and distrust is allowed; long pages are read whole; only the named columns
are read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stallworks.llm.tables import Scratch

UNIT, DAMPING, THRESHOLD, SLICE = 1_000_000, 0.85, 500_000, 4096
#: host, path, verdict
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
# What is cut out of urls and pages.
HOST = "(?s)^.*?://([^/?#]*)"
PATH = "(?s)^.*?://[^/?#]*([^?#]*)"
HREF = "<[Aa]\\b[^>]*[\\x20\\x09-\\x0D][Hh][Rr][Ee][Ff][\\x20\\x09-\\x0D]*=[\\x20\\x09-\\x0D]*[\"']?[\\x20\\x09-\\x0D]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\"'<>\\x20\\x09-\\x0D]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def ranked(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Rules in the order in which the first that fits wins."""
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))


def first_rule(host: Column, path: Column, rules: list[tuple[str, str, str]], value) -> Column:
    out = F.lit(None).cast("string")
    for rule in reversed(ranked(rules)):
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], carry: list[str]) -> DataFrame:
    """The carried columns, host, path, rule and ``ruled`` (the rule's verdict) of every page."""
    cut = pages.select(*carry, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    return cut.withColumn("rule", first_rule(host, path, rules, lambda r: r[0] + r[1])).withColumn(
        "ruled", first_rule(host, path, rules, lambda r: r[2]))


def seeds(pages: DataFrame) -> DataFrame:
    """(kind, host, got): what rules give each host to start with; one row per kind and host, nothing left out."""
    share = lambda verdict: F.floor(F.lit(UNIT) * F.count(F.when(F.col("ruled") == verdict, 1)) / F.count(F.lit(1))).cast("long")
    hosts = pages.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    return hosts.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "got"))


def host_links(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts: links of pages, and each host to its parent domains."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1)), lambda t: F.translate(t, UPPER, LOWER)))
    linked = pages.select(url_host(F.col("url")).alias("src"), F.explode(found).alias("dst")).filter("src <> '' and src <> dst")
    linked = linked.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    labels = F.split("host", "\\.", -1)
    name = lambda at: F.array_join(F.slice("labels", at, F.size("labels")), ".")
    chain = F.transform(F.sequence(F.lit(1), F.size("labels") - 2), lambda i: F.struct(name(i).alias("src"), name(i + 1).alias("dst")))
    family = hosts.select(labels.alias("labels")).filter("size(labels) > 2").select(F.inline(chain)).distinct()
    family = family.filter("src <> '' and dst <> '' and src <> dst").withColumn("weight", F.lit(1).cast("long"))
    return linked.unionByName(family).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def sliced(scratch: Scratch, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of both kinds (kind, host, slice, next, share), and (kind, host, slices) of all hosts that have some."""
    trust = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("next"), "weight")
    distrust = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("next"), "weight")
    both = trust.unionByName(distrust)
    sums = both.groupBy("kind", "host").agg(F.sum("weight").alias("whole"), F.ceil(F.count(F.lit(1)) / SLICE).cast("long").alias("slices"))
    sums = scratch.write(sums)
    share = F.col("weight").cast("double") / F.col("whole").cast("double")
    out = both.join(sums, ["kind", "host"]).select(
        "kind", "host", F.pmod(F.xxhash64("next"), F.col("slices")).alias("slice"), "next", share.alias("share"))
    return scratch.write(out), sums.select("kind", "host", "slices")


def spread(scratch: Scratch, start: DataFrame, links: DataFrame, hubs: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(kind, host, score): all that a host ever gets."""
    now = scratch.write(start.filter("got > 0"))
    past = [now]
    while now.limit(1).count():
        out = now.join(hubs, ["kind", "host"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        handed = F.floor(F.lit(damping) * F.col("got").cast("double") * F.col("share")).cast("long")
        got = out.join(links, ["kind", "host", "slice"]).select("kind", F.col("next").alias("host"), handed.alias("got")).filter("got > 0")
        now = scratch.write(got.groupBy("kind", "host").agg(F.sum("got").alias("got")))
        past.append(now)
        if len(past) > 8:  # past rounds are one table again, so plans stay short
            past, old = [now, scratch.write(_sums(past[:-1]))], past[:-1]
            scratch.drop(*old)
    return _sums(past).withColumnRenamed("got", "score")


def _sums(rounds: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rounds).groupBy("kind", "host").agg(F.sum("got").alias("got"))


def host_scores(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(host, trust, distrust) of every host that gets any, in millionths of a host whose pages are all allowed or all blocked."""
    scratch = Scratch(pages.sparkSession)
    start = scratch.write(seeds(judged(pages, rules, [])))
    links, hubs = sliced(scratch, scratch.write(host_links(pages, start.select("host").distinct())))
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0)).alias(kind)
    return scratch.write(spread(scratch, start, links, hubs).groupBy("host").agg(score("trust"), score("distrust")))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: int = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for (page_id, url, html)."""
    scores = host_scores(pages, rules)
    done = judged(pages, rules, ["page_id"]).join(scores, "host", "left")
    trust, distrust = (F.coalesce(c, F.lit(0)).cast("long") for c in ("trust", "distrust"))
    spread_verdict = F.when(distrust - trust >= threshold, "block").otherwise("allow")
    return done.select("page_id", "host", "path", "rule", F.coalesce("ruled", spread_verdict).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
