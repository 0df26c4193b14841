"""URL filter: rules and spread trust against a plain version, and the defined cases."""

import random
import re
from collections import defaultdict
from math import floor

from stallworks.llm import url_trust as U


def plain(pages, rules=U.RULES):
    """page_id -> (host, path, rule, verdict, trust, distrust), round by round over dictionaries."""
    cut = {}
    hosts = defaultdict(list)
    links = defaultdict(int)
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    for page_id, url, html in pages:
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = lower(re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host):])[0]
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        cut[page_id] = (host, path, best)
        if host:
            hosts[host].append(best[2] if best else None)
        for target in {lower(t) for t in re.findall(U.HREF, html or "")}:
            if host and target != host:
                links[host, target] += 1
    for host in hosts:
        labels = host.split(".")
        for i in range(len(labels) - 2):
            links[".".join(labels[i:]), ".".join(labels[i + 1:])] += 0
    family = {(".".join(h.split(".")[i:]), ".".join(h.split(".")[i + 1:])) for h in hosts for i in range(len(h.split(".")) - 2)}
    for pair in family:
        links[pair] += 1
    scores = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        out = defaultdict(list)
        for (a, b), w in links.items():
            if w:
                out[a if kind == "trust" else b].append((b if kind == "trust" else a, w))
        got = {h: floor(U.UNIT * v.count(verdict) / len(v)) for h, v in hosts.items()}
        total = defaultdict(int)
        while any(got.values()):
            after = defaultdict(int)
            for h, r in got.items():
                total[h] += r
                whole = sum(w for _, w in out[h])
                for other, w in out[h]:
                    after[other] += floor(U.DAMPING * float(r) * (w / whole))
            got = after
        scores[kind] = total
    return {p: (h, path, r and r[0] + r[1], r[2] if r else "block" if scores["distrust"][h] - scores["trust"][h] >= U.THRESHOLD else "allow",
                scores["trust"][h] if h else 0, scores["distrust"][h] if h else 0) for p, (h, path, r) in cut.items()}


SCHEMA = "page_id long, url string, html string, host string, trust long, kind string, rule string"


def frame(spark, pages):
    return spark.createDataFrame([(*p, "x", 5, "x", "x") for p in pages], SCHEMA)


def got(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.trust, r.distrust) for r in df.collect()}


def anchor(*hosts):
    return "".join(f'<p><a class="x" href="https://{h}/page?q=1">t</a>' for h in hosts)


def test_trust_and_distrust_follow_links(spark):
    pages = [(1, "http://good.com/a", anchor("friend.org", "other.org")), (2, "http://friend.org/", anchor("third.org")),
             (3, "http://bad.net/es/", anchor("good.com")), (4, "http://farm.org/x", anchor("bad.net")), (5, "http://third.org/", ""),
             (6, "http://other.org/", ""), (7, "http://sub.farm2.org/x", anchor("farm.org")), (8, "http://lone.org", None)]
    rows = got(U.url_filter(frame(spark, pages)))
    assert rows == plain(pages)
    assert rows[4][3] == "block" and rows[7][3] == "block"  # one and two links away from a blocked host
    assert all(rows[i][3] == "allow" for i in (2, 5, 6, 8)) and rows[5][4] > 0
    assert rows[1][4:] == (U.UNIT, 0)  # a blocked host cannot spoil the one that it links to


def test_random_graph_with_cycles_and_a_hub(spark, monkeypatch):
    monkeypatch.setattr(U, "SLICE", 4)  # the hub's links fall into several slices
    rng = random.Random(4)
    hosts = [f"h{i}.{rng.choice(['com', 'net', 'org'])}" for i in range(40)] + ["hub.org", "a.b.c.org", "WWW.Example.com"]
    pages = []
    for i in range(300):
        host = "hub.org" if i % 3 == 0 else rng.choice(hosts)
        pages.append((i, f"http://{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}", anchor(*rng.sample(hosts, 3))))
    assert got(U.url_filter(frame(spark, pages).repartition(7))) == plain(pages)


RULED = [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme/en/", "", "", None, "allow"), ("http://", "", "", None, "allow"),
    ("HTTP://A.COM/x", "a.com", "/x", "com/", "allow"), ("http://a.com", "a.com", "", None, "allow"), ("http://a.com?x=/en/", "a.com", "", None, "allow"),
    ("http://com/x", "com", "/x", "com/", "allow"), ("http://notcom/x", "notcom", "/x", None, "allow"),
    ("http://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"), ("http://b.example.com/en/", "b.example.com", "/en/", "example.com/en/", "block"),
    ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"), ("http://example.com/en", "example.com", "/en", "com/", "allow"),
    ("http://www.example.com/en/#f", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://x.www.example.com/en/?q", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("x://a.net/es/://b.com/", "a.net", "/es/://b.com/", "net/es/", "block"), ("http://a.net/fr/\nx", "a.net", "/fr/\nx", "net/fr/", "block"),
    ("http://ÄB.net/de/", "Äb.net", "/de/", None, "allow"),
]


def test_rules(spark):
    pages = [(i, r[0], None) for i, r in enumerate(RULED)]
    rows = got(U.url_filter(frame(spark, pages)))
    assert [rows[i][:4] for i in range(len(RULED))] == [r[1:] for r in RULED]
    assert rows == plain(pages)


def test_ties_repeated_rows_long_pages_and_empty_table(spark):
    long = "<p>" + "x " * 500_000 + anchor("bad.net")
    pages = [(1, "http://bad.net/es/", ""), (2, "http://liker.org/", long), (2, "http://liker.org/", long), (None, "http://even.org/", "")]
    rows = U.url_filter(frame(spark, pages)).collect()
    assert len(rows) == 4 and [r.verdict for r in rows if r.page_id == 2] == ["block", "block"]
    assert U.url_filter(frame(spark, pages).limit(0)).collect() == []
    # equal trust and distrust: allowed
    both = [(1, "http://both.net/es/", ""), (2, "http://both.net/com/", ""), (3, "http://both.net/de/", "")]
    rules = [("net", "/es/", "block"), ("net", "/com/", "allow")]
    assert got(U.url_filter(frame(spark, both), rules))[3][3:] == ("allow", 333_333, 333_333)


def test_no_python_in_the_plan(spark):
    plan = U.url_filter(frame(spark, [(1, "http://a.com/", "")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
