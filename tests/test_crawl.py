"""Crawl and entry operators against brute force."""

import random

from pyspark.sql import functions as F

from stallworks.operators import crawl, entries as N
from stallworks.functions import url as U


def walk(graph, seed, limit):
    """Queue walk over numbered pages, as a person would write it."""
    seen, queue = [], [seed]
    while queue and len(seen) < limit:
        page = queue.pop(0)
        if page in seen:
            continue
        seen.append(page)
        queue += [p for p in sorted(graph.get(page, [])) if p not in seen and p not in queue]
    return seen


def test_walk_matches_brute_force(spark):
    rng = random.Random(5)
    number = lambda i: f"https://d.org/l/page/{i}"
    graph = {i: sorted({rng.randrange(1, 60) for _ in range(3)} - {i}) for i in range(1, 60)}
    edges = [(number(a), number(b)) for a, bs in graph.items() for b in bs] + [(number(1), "https://other.org/l/page/2")]
    series = F.to_json(U.page_series("dst_url"))
    frame = spark.createDataFrame(edges, "src_url string, dst_url string").select("src_url", "dst_url", series.alias("series"), U.page_number("dst_url").alias("page_no"))
    known = spark.createDataFrame([(number(i),) for i in range(1, 60)], "url string")
    seeds = spark.createDataFrame([(number(1),)], "seed_url string")
    for limit in (1, 7, 250):
        got = crawl.crawl_reachable(seeds, frame, known, limit).orderBy("place").collect()
        assert [r.directory_page for r in got] == walk(graph, 1, limit)
        assert [r.place for r in got] == list(range(1, len(got) + 1))


def test_stall_cut(spark):
    pages = {1: "ab", 2: "bc", 3: "c", 4: "d", 5: "d", 6: "a", 7: "e"}
    rows = [("s", p, c) for p, cs in pages.items() for c in cs]
    kept = N.stall_cut(spark.createDataFrame(rows, "seed_url string, directory_page int, profile_url string"))
    assert sorted({r.directory_page for r in kept.collect()}) == [1, 2, 3, 4, 5, 6]


def test_numbering_and_dedupe(spark):
    rng = random.Random(1)
    rows = [(f"s{0 if rng.random() < 0.4 else rng.randrange(5)}", rng.randrange(6), i, f"Name {rng.randrange(40)}", f"u{rng.randrange(60)}", "") for i in range(600)]
    frame = spark.createDataFrame(rows, "seed_url string, directory_page int, ord int, company_name string, profile_url string, website_url_hint string")
    got = N.dedupe_entries(frame, ["directory_page"], ["ord"]).collect()
    for seed in {r[0] for r in rows}:
        want, seen = [], set()
        for row in sorted((r for r in rows if r[0] == seed), key=lambda r: (r[1], r[2])):
            if row[4] not in seen:
                seen.add(row[4])
                want.append((row[4], row[3]))
        mine = sorted((r for r in got if r.seed_url == seed), key=lambda r: r.sort_index)
        assert [(r.profile_url, r.company_name) for r in mine] == want
        assert [r.sort_index for r in mine] == list(range(len(want)))


def test_running_count_over_chunks(spark):
    rng = random.Random(2)
    rows = [("k", i, rng.random() < 0.3) for i in rng.sample(range(100000), 3000)]
    frame = spark.createDataFrame(rows, "k string, ord int, flag boolean")
    got = N.running_count(frame, ["k"], "ord", F.col("flag"), "n", chunk=64).orderBy("ord").collect()
    total = 0
    for row in got:
        total += row.flag
        assert row.n == total


def test_page_patterns(spark):
    seeds = spark.createDataFrame([("https://d.org/l?pg=x&p=3",), ("https://d.org/l",)], "seed_url string")
    first = crawl.page_url_patterns(seeds).filter("priority = 0").orderBy("seed_url").collect()
    assert [r.param for r in first] == ["page", "p"]


def test_source_precedence_and_gate(spark):
    rows = [("a", 2, 1), ("a", 1, 2), ("a", 1, 3), ("b", 3, 4)]
    best = N.best_source(spark.createDataFrame(rows, "seed_url string, priority int, n int"))
    assert sorted(r.n for r in best.collect()) == [2, 3, 4]
    assert sorted(r.n for r in N.at_least(best, ["seed_url"], 2).collect()) == [2, 3]


def follow(hops, url):
    """Frames first, then directory links, never back to a visited page."""
    seen = [url]
    while url in hops:
        fixed, frame, link = hops[url]
        target = None if fixed else next((t for t in (frame, link) if t and t not in seen), None)
        if target not in hops:
            break
        url = target
        seen.append(url)
    return url


def page(i):
    return f"https://p{i}.org/"


def test_seeds_follow_long_chains_and_circles(spark):
    rng = random.Random(8)
    some = lambda: page(rng.randrange(70)) if rng.random() < 0.6 else None
    hops = {page(100 + i): (False, None, page(101 + i)) for i in range(40)} | {page(140): (False, None, None)}  # a chain of 40
    hops |= {page(200 + i): (False, page(200 + (i + 1) % 7), None) for i in range(7)}  # a circle of 7, and a way into it
    hops |= {page(300): (False, None, page(203)), page(301): (False, page(301), page(300)), page(302): (True, page(300), None), page(303): (False, page(999), page(300))}
    hops |= {page(i): (rng.random() < 0.1, some(), some()) for i in range(70)}
    frame = spark.createDataFrame([(u, *h) for u, h in hops.items()], "url string, is_platform boolean, frame_url string, link_url string")
    seeds = [*hops, "https://nowhere.org/"]
    got = crawl.resolve_seeds(spark.createDataFrame([(s,) for s in seeds], "seed_url string"), frame).collect()
    assert sorted((r.seed_url, r.resolved_url) for r in got) == sorted((s, follow(hops, s)) for s in seeds)


def test_walk_over_a_long_chain(spark):
    """Pages that are linked only from the one before; rounds of visited pages are merged on the way."""
    number = lambda s, i: f"https://s{s}.org/l/page/{i}"
    sizes = {1: 20, 2: 3, 3: 1}
    edges = [(number(s, i), number(s, i + 1)) for s, n in sizes.items() for i in range(1, n)] + [(number(1, 20), number(1, 1))]
    frame = spark.createDataFrame(edges, "src_url string, dst_url string").select(
        "src_url", "dst_url", F.to_json(U.page_series("dst_url")).alias("series"), U.page_number("dst_url").alias("page_no"))
    known = spark.createDataFrame([(number(s, i),) for s, n in sizes.items() for i in range(1, n + 1)], "url string")
    seeds = spark.createDataFrame([(number(s, 1),) for s in sizes], "seed_url string")
    got = crawl.crawl_reachable(seeds, frame, known).collect()
    assert sorted((r.seed_url, r.place, r.page_url) for r in got) == sorted((number(s, 1), i, number(s, i)) for s, n in sizes.items() for i in range(1, n + 1))
