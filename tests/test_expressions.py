"""Table-driven tests of the URL, text, date and score expressions."""

from pyspark.sql import functions as F

from stallworks.functions import dates as D, scores as S, text as T, url as U


def test_normalize_and_host(one):
    rows = [
        ("HTTPS://WWW.A.com:80/x?y=1#z", "https://WWW.A.com:80/x?y=1", "a.com"),
        (" http://b.org/a b ", "http://b.org/a b", "b.org"),
        ("http://user@c.net", "http://user@c.net", "c.net"),
        ("ftp://d.org/x", None, "d.org"), ("http:///x", None, ""), ("", None, ""), ("/rel", None, ""),
    ]
    got = one([(r[0],) for r in rows], "u string", U.normalize_http_url("u"), U.host_key("u"))
    assert got == [(r[1], r[2]) for r in rows]


def test_resolve(one):
    base = "https://d.org/a/b/c?q=1"
    rows = [
        ("../x", "https://d.org/a/x"), ("./", "https://d.org/a/b/"), ("..", "https://d.org/a/"), ("?p=2", "https://d.org/a/b/c?p=2"),
        ("//e.org", "https://e.org"), ("/a//b/./c/../d", "https://d.org/a/b/d"), ("", "https://d.org/a/b/c?q=1"),
        ("mailto:x@y.z", None), ("http://f.org/../g", "http://f.org/../g"), ("../../../../z", "https://d.org/z"),
    ]
    got = one([(r[0],) for r in rows], "r string", U.resolve_url(F.lit(base), "r"))
    assert [g[0] for g in got] == [r[1] for r in rows]
    targets = [("foo.com/x", "https://foo.com/x"), ("tel:12", None), ("page", "https://d.org/a/b/page"), ("#x", None)]
    got = one([(r[0],) for r in targets], "r string", U.resolve_target(F.lit(base), "r"))
    assert [g[0] for g in got] == [r[1] for r in targets]


def test_groups_and_pages(one):
    rows = [
        ("https://a.b/x/y/z", "/x/y/*", None), ("https://a.b/12", "/{num}", None), ("https://a.b/abc/", "/{slug}", None), ("https://a.b", "/", None),
        ("https://a.b/P?companyID=3&page=2&pg=x", "/p?companyid", 2), ("https://a.b/l/Page/7/", "/l/page/*", 7), ("https://a.b/l?my_page=4", "/{slug}", 4),
    ]
    got = one([(r[0],) for r in rows], "u string", U.url_group("u"), U.page_number("u"))
    assert got == [(r[1], r[2]) for r in rows]


def test_same_site_assets_social(one):
    rows = [
        ("https://www.a.com/x.PDF", "https://a.com", True, True, False), ("https://sub.a.com/y", "https://a.com", True, False, False),
        ("https://ba.com", "https://a.com", False, False, False), ("https://netflix.com/", "https://x.com", False, False, True),
    ]
    got = one([r[:2] for r in rows], "a string, b string", U.same_site("a", "b"), U.looks_like_asset("a"), U.is_social_url("a"))
    assert got == [r[2:] for r in rows]


def test_clean_company_name(one):
    rows = [
        ("acme  furniture logo", "Acme Furniture"), ("Foo USA (3)", "Foo"), ("Blue Co 2024", "Blue Co"), ("gm", "GM"), ("Tom &amp; Jerry", "Tom & Jerry"),
        ("16 West", "16 West"), ("Open Menu close", ""), ("The Logotype", "The Logotype"), ("A Canada UK", "A"), ("", ""),
    ]
    assert [g[0] for g in one([(r[0],) for r in rows], "t string", T.clean_company_name("t"))] == [r[1] for r in rows]


def test_name_predicates(one):
    rows = [
        ("Acme Works", True, False, False), ("View Details", False, False, False), ("page 3", False, False, True), ("3M", False, False, True), ("7X9", True, False, False),
        ("12345", False, True, True), ("Acme", True, False, True), ("IBM", True, False, False), ("x" * 141, False, False, True),
    ]
    got = one([(r[0],) for r in rows], "t string", T.is_companyish("t"), T.is_machine_name("t"), T.is_low_confidence_name("t"))
    assert got == [r[1:] for r in rows]


def test_booth_and_place(one):
    assert one([("A12 Acme Works New Exhibitor",), ("B 7",), ("Clear Filters",)], "t string", T.booth_and_name("t")["name"], T.booth_and_name("t")["booth"]) == [
        ("Acme Works", "A12"), ("", ""), ("", "")]
    got = one([("at RENO, NV or Reno, Nevada; Paris, France",)], "t string", F.to_json(T.city_region_pairs("t")))
    assert got == [('[{"city":"Reno","region":"NV"}]',)]


def test_domain_match(one):
    rows = [
        ("Acme Works", "https://www.acmeworks.com/", True), ("Big Blue Co", "https://bb.com", True), ("Boreal Foods", "https://borea.io", True),
        ("Cedar Glass", "https://privacy.example.org", False), ("518 North", "https://518north.com", True), ("A", "https://a.com", False),
    ]
    got = one([r[:2] for r in rows], "n string, u string", S.name_matches_domain("n", "u"), S.validated_website("n", "u"))
    assert [g[0] for g in got] == [r[2] for r in rows]
    assert [g[1] != "" for g in got] == [r[2] for r in rows]


def test_plausible_website(one):
    rows = [("https://acme.com", True), ("https://facebook.com/a", False), ("https://a.com/x.pdf", False), ("https://calendly.com/a", False),
            ("https://a.com/hc/x", False), ("https://x.expofp.com", False), ("nothing", False), ("http://localhost/", False)]
    assert [g[0] for g in one([(r[0],) for r in rows], "u string", S.plausible_website("u"))] == [r[1] for r in rows]


def test_dates(one):
    today = F.to_date(F.lit("2026-12-01"))
    rows = [("2026-10-24", "2026-10-24"), ("10/24/26", "2026-10-24"), ("1/2/70", "1970-01-02"), ("Oct 24 2026", "2026-10-24"), ("october 24, 2026", "2026-10-24"),
            ("Nov 20", "2026-11-20"), ("Jan 5,", "2027-01-05"), ("October 1", "2027-10-01"), ("Feb 29", None), ("soon", None), ("24.10.2026", None)]
    got = one([(r[0],) for r in rows], "t string", F.date_format(D.parse_show_date("t", today), "yyyy-MM-dd"))
    assert [g[0] for g in got] == [r[1] for r in rows]
    days = one([(d,) for d in (1, 2, 3, 4, 11, 12, 13, 21, 22, 30)], "d int", D.ordinal_day(F.col("d")))
    assert [d[0] for d in days] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "22nd", "30th"]


def test_conference_label(one):
    rows = [("Boat Expo 2026 | Exhibitor Directory", "Boat Expo 2026"), ("Exhibitors", "Exhibitors"), ("", "")]
    got = one([(r[0],) for r in rows], "t string", T.conference_label("t"))
    assert got[0][0].startswith("Boat Expo 2026") and got[1][0] == "Exhibitors" and got[2][0] == ""
