"""Scores and predicates over links, names, images.  NULL means "rejected".

Functions take a record: anything that yields a Column by field name, be it a
struct Column or ``row`` (a view of the columns of a table).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stallworks import rules
from stallworks.functions import text as T, url as U
from stallworks.functions.binding import let


class _Row:
    def __getitem__(self, name: str) -> Column:
        return F.col(name)


row = _Row()


def points(*terms: tuple[Column, float]) -> Column:
    """Sum of the points whose condition holds."""
    total = F.lit(0.0)
    for condition, value in terms:
        total = total + F.when(condition, F.lit(float(value))).otherwise(0.0)
    return total


def outside_main(record) -> Column:
    return record["in_header"] | record["in_footer"] | record["in_nav"]


def domain_text(text: Column) -> Column:
    return text.rlike(rules.DOMAIN_TEXT)


def discovery_label_score(text: Column | str) -> Column:
    """How much a link label promises a directory of participants."""

    def score(label: Column) -> Column:
        total = points(
            (T.is_one_of(label, rules.DISCOVERY_LABELS), 140),
            (label.contains("participating"), 55),
            (label.contains("directory"), 40),
            *[(label.contains(word), 25) for word in rules.DISCOVERY_WORDS],
            (label.contains("portal"), -45),
            (label.contains("floor plan") | label.contains("floorplan"), -70),
            (label.contains("register") | label.contains("faq"), -25),
        )
        return F.when(label != "", total)

    return let(T.canonical_label(text), score)


def listing_bonus(group: Column, average_length: Column, any_www: Column) -> Column:
    return points(
        (T.contains_any(group, rules.LISTING_GROUP_WORDS), 20),
        (average_length.between(4, 80), 10),
        (any_www, -15),
        (group.isin("/{slug}", "/{num}"), -8),
    )


def container_name_score(text: Column | str) -> Column:
    return let(
        U._col(text),
        lambda t: F.when(
            T.is_companyish(t),
            20.0
            + points(
                (F.size(T.words(t)).between(1, 6), 10), (F.length(t) <= 80, 8), (t.rlike(r"\p{Nd}"), -6)
            ),
        ),
    )


def profile_action_score(action, directory_url: Column) -> Column:
    """How much an action looks like the way to a company's profile."""
    url = action["absolute_url"]
    label = F.lower(action["display_text"])
    path = F.lower(U.path(url))
    keys = F.transform(U.query_pairs(url), lambda p: F.lower(p["key"]))
    allowed = (
        (url != "") & ~outside_main(action) & U.same_site(url, directory_url) & ~U.looks_like_asset(url)
    )
    total = F.lit(18.0) + points(
        (action["source_attr"] != "href", 8),
        (action["tag"].isin("button", "div"), 6),
        (action["in_main"], 5),
        (T.contains_any(path, rules.PROFILE_PATHS), 35),
        (T.contains_any(label, rules.PROFILE_LABELS), 20),
        (F.size(U.path_segments(url)) >= 2, 6),
        (F.coalesce(U.normalize_http_url(url) == U.normalize_http_url(directory_url), F.lit(False)), -80),
        (U.page_number(url).isNotNull(), -40),
        (F.exists(keys, U.is_page_param), -35),
    )
    return F.when(allowed, total)


def external_link_score(link, profile_url: Column) -> Column:
    """How much an off-site link looks like the company's own website."""
    url = link["absolute_url"]
    text = F.lower(link["display_text"])
    host = U.host_key(url)
    path_and_query = F.concat(F.lower(U.path(url)), F.lit("?"), F.lower(U.query(url)))
    keys = F.transform(U.query_pairs(url), lambda p: F.lower(p["key"]))
    signature = F.lower(F.array_join(link["signature"], " "))
    allowed = (url != "") & ~U.same_site(url, profile_url) & ~U.looks_like_asset(url)
    total = F.lit(40.0) + points(
        (link["in_footer"] | link["in_header"], -35),
        (link["in_nav"], -25),
        (link["in_main"], 12),
        (signature.rlike("social|share|footer|nav"), -25),
        (text.rlike("website|homepage|visit"), 25),
        (text.startswith("www.") | domain_text(text), 30),
        (host.contains("."), 4),
        (U.is_social_url(url), -18),
        (text.isin("facebook", "instagram", "linkedin", "twitter", "youtube", "pinterest"), -30),
        (T.contains_any(host, rules.EVENT_HOSTS), -18),
        (T.contains_any(path_and_query, rules.EVENT_PATHS), -85),
        (F.exists(keys, lambda k: k.isin(rules.EVENT_QUERY_KEYS)), -85),
        (T.contains_any(text, rules.EVENT_TEXTS), -45),
    )
    return F.when(allowed, total)


def image_worthy(url: Column, alt: Column) -> Column:
    """Do address and caption speak of a list of participants?"""
    both = F.concat(F.lower(url), F.lit(" "), F.lower(alt))
    return T.contains_any(both, rules.IMAGE_WORDS) & ~T.contains_any(both, rules.IMAGE_NOISE)


def image_score(image, seed_url: Column) -> Column:
    url, alt = image["absolute_url"], image["alt_text"]
    readable = F.lower(U.path(url)).rlike(r"\.(?:" + "|".join(rules.IMAGE_EXTENSIONS) + ")$")
    allowed = (url != "") & ~outside_main(image) & U.same_site(url, seed_url) & readable
    total = points(
        (image["in_main"], 20),
        ((image["width"] >= 600) | (image["height"] >= 400), 18),
        (image["width"] * image["height"] >= 250000, 18),
        (image_worthy(url, alt), 35),
        (F.size(T.words(alt)) >= 6, 12),
    )
    return F.when(allowed, total)


def iframe_score(url: Column, seed_url: Column) -> Column:
    lowered = F.lower(url)
    tracking = T.contains_any(U.host_key(url), rules.TRACKING_HOSTS) | T.contains_any(lowered, rules.TRACKING_PATHS)
    total = points(
        (lowered.rlike("exhibitor|directory|vendor|sponsor"), 40),
        (T.contains_any(lowered, rules.PLATFORM_HOSTS), 80),
        (U.same_site(url, seed_url), 10),
    )
    return F.when(~tracking & (total > 0), total)


def keys_match(a: Column, b: Column) -> Column:
    """Two brand keys: equal, or one inside the other."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def host_brand_key(url: Column | str) -> Column:
    return T.brand_key(U.infer_name_from_url(url))


def brand_match(name: Column | str, url: Column | str) -> Column:
    return let(
        F.struct(T.brand_key(name).alias("a"), host_brand_key(url).alias("b")),
        lambda keys: keys_match(keys["a"], keys["b"]),
    )


def company_name_score(name: Column, website_url: Column, weight: Column) -> Column:
    """Score of an already cleaned name found on the company's own site."""

    def brand_points(keys: Column) -> Column:
        both = (keys["a"] != "") & (keys["b"] != "")
        return F.when(both & (keys["a"] == keys["b"]), 125.0).when(keys_match(keys["a"], keys["b"]), 70.0).otherwise(0.0)

    count = F.size(T.words(name))
    label = T.canonical_label(name)
    total = (
        weight
        + 20.0
        + F.when(count.between(1, 5), 32.0).when(count <= 7, 12.0).otherwise(-30.0)
        + points(
            (F.length(name) > 60, -25),
            (F.length(name) > 90, -30),
            (T.contains_any(label, rules.NAME_GENERIC_MARKERS), -30),
            (name.rlike(r"\p{Nd}"), -12),
            (T.is_upper_cased(name) & (F.length(name) <= 10), 8),
        )
        + let(F.struct(T.brand_key(name).alias("a"), host_brand_key(website_url).alias("b")), brand_points)
    )
    rejected = (name == "") | T.is_machine_name(name) | label.isin("home", "homepage", "welcome")
    return F.when(~rejected, total)


def plausible_website(url: Column | str, profile_url: Column | None = None, branded: Column | None = None) -> Column:
    """Can this be a company's own website?

    ``branded``: does one of the names known for it match?  NULL where none is known.
    """

    def judged(u: Column) -> Column:
        host = U.host_key(u)
        good = (
            ~U.looks_like_asset(u)
            & ~U.is_social_url(u)
            & host.contains(".")
            & ~T.contains_any(host, rules.NON_COMPANY_HOSTS)
            & ~T.contains_any(F.lower(U.path(u)), rules.NON_COMPANY_PATHS)
            & ~T.contains_any(host, rules.EVENT_HOSTS)
        )
        if profile_url is not None:
            good = good & ~U.same_site(u, profile_url)
        if branded is not None:
            service = host.rlike("^(?:" + T.pattern_of(rules.NON_BRAND_HOST_PREFIXES) + ")")
            good = good & (F.coalesce(branded, F.lit(True)) | ~service)
        return good

    return F.coalesce(let(U.normalize_http_url(url), judged), F.lit(False))


def name_matches_domain(name: Column | str, url: Column | str) -> Column:
    """Does the company's name show in its domain?"""

    def judged(v: Column) -> Column:
        tokens, host_tokens, host_key_, name_key = v["tokens"], v["host_tokens"], v["host_key"], v["name_key"]
        acronym = T.acronym_of(tokens)
        long_hosts = F.filter(host_tokens, lambda h: F.length(h) >= 4)

        def stem_hit(token: Column) -> Column:
            stem = F.substring(token, 1, 4)
            return (F.length(token) >= 4) & (
                host_key_.contains(stem) | F.exists(long_hosts, lambda h: h.contains(stem) | token.contains(h))
            )

        return (
            (F.size(tokens) > 0)
            & (host_key_ != "")
            & (
                F.exists(tokens, lambda t: host_key_.contains(t) | F.array_contains(host_tokens, t))
                | F.exists(tokens, stem_hit)
                | ((acronym != "") & (host_key_.contains(acronym) | F.array_contains(host_tokens, acronym)))
                | (
                    (F.length(name_key) >= 5) & (F.length(host_key_) >= 5)
                    & (F.substring(name_key, 1, 5) == F.substring(host_key_, 1, 5))
                )
            )
        )

    def keys(names: Column) -> Column:
        return F.struct(
            T.brand_tokens(names["name"]).alias("tokens"),
            T.brand_tokens(names["host"]).alias("host_tokens"),
            T.brand_key(names["host"]).alias("host_key"),
            T.brand_key(names["name"]).alias("name_key"),
        )

    names = F.struct(U._col(name).alias("name"), U.infer_name_from_url(url).alias("host"))
    return F.coalesce(let(let(names, keys), judged), F.lit(False))


def validated_website(name: Column | str, url: Column | str) -> Column:
    """The URL if the name matches its domain, else ''."""
    return let(
        F.coalesce(U.normalize_http_url(url), F.lit("")),
        lambda u: F.when((u != "") & name_matches_domain(name, u), u).otherwise(""),
    )
