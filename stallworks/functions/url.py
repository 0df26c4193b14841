"""URL expressions: native Columns, so they run inside the plan that uses them."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from stallworks import rules
from stallworks.functions.binding import let

# The generic URI pattern of RFC 3986, appendix B.
URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?"
PAGE_IN_PATH = r"(?i)/page/(\d+)/?$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def any_of(words: list[str]) -> str:
    """A pattern that finds any of the words."""
    return "(?:" + "|".join(re.escape(word) for word in words) + ")"


def tidy(url: Column | str) -> Column:
    """Outer white space and inner line breaks are not part of a URL."""
    return F.translate(F.regexp_replace(_col(url), r"(?U)^\s+|\s+$", ""), "\t\r\n", "")


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), URI, 1))


def netloc(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), URI, 2)


def full_path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), URI, 3)


def path(url: Column | str) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(full_path(url), ";[^/]*$", "")


def query(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), URI, 4)


def fragment(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), URI, 5)


def join_parts(scheme_: Column, netloc_: Column, path_: Column, query_: Column, fragment_: Column | None = None) -> Column:
    """Put a URL together; empty query and fragment leave no mark."""
    rooted = F.when((path_ != "") & ~path_.startswith("/"), F.concat(F.lit("/"), path_)).otherwise(path_)
    out = F.concat(scheme_, F.lit("://"), netloc_, rooted, F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(""))
    if fragment_ is None:
        return out
    return F.concat(out, F.when(fragment_ != "", F.concat(F.lit("#"), fragment_)).otherwise(""))


def normalize_http_url(url: Column | str) -> Column:
    """The URL without fragment; NULL unless it is http(s) and has a host."""
    return let(
        tidy(url),
        lambda u: F.when(
            u.rlike("^[hH][tT][tT][pP][sS]?://[^/?#]"), let(F.substring_index(u, "#", 1), _with_plain_scheme)
        ),
    )


def _with_plain_scheme(url: Column) -> Column:
    """Scheme in lower case, no question mark without a query behind it."""
    first = F.locate("?", url)
    rest = F.substr(url, F.locate(":", url), F.when(first == F.length(url), F.length(url) - F.locate(":", url)).otherwise(F.length(url)))
    return F.concat(F.lower(F.substring_index(url, ":", 1)), rest)


def host_key(url: Column | str) -> Column:
    """Lower-case host without ``www.``, user and port; '' where there is none."""
    host = F.lower(F.regexp_extract(netloc(tidy(url)), r"^(?:.*@)?([^:@]*)", 1))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def same_host_family(a: Column, b: Column) -> Column:
    """``same_site`` for two columns that already hold host keys."""
    return (
        (a != "")
        & (b != "")
        & ((a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)))
    )


def same_site(a: Column | str, b: Column | str) -> Column:
    return let(F.struct(host_key(a).alias("a"), host_key(b).alias("b")), lambda hosts: same_host_family(hosts["a"], hosts["b"]))


def looks_like_asset(url: Column | str) -> Column:
    return F.lower(path(url)).rlike(r"\.(?:" + "|".join(rules.ASSET_EXTENSIONS) + ")$")


def host_has(url: Column | str, markers: list[str]) -> Column:
    return host_key(url).rlike(any_of(markers))


def is_social_url(url: Column | str) -> Column:
    return host_has(url, rules.SOCIAL_HOSTS)


def is_page_param(key: Column | str) -> Column:
    name = F.replace(F.lower(F.trim(F.regexp_replace(_col(key), r"(?U)\s+", " "))), F.lit(" "), F.lit("_"))
    return name.rlike("^(?:" + "|".join(rules.PAGE_PARAMS) + r")\z|_page(?:_num)?\z")


def _decode(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def query_pairs(url: Column | str) -> Column:
    """Ordered key/value structs of the query; blank values stay, malformed escapes stay raw."""
    parts = F.filter(F.split(query(_col(url)), "&"), lambda part: part != "")
    return F.transform(
        parts,
        lambda part: F.struct(
            _decode(F.substring_index(part, "=", 1)).alias("key"),
            _decode(F.regexp_extract(part, r"^[^=]*=([\s\S]*)$", 1)).alias("value"),
        ),
    )


def _encode_pairs(pairs: Column) -> Column:
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&"
    )


def path_segments(url: Column | str) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def url_group(url: Column | str) -> Column:
    """Shape of a URL: what profile links of one directory have in common."""
    url = _col(url)
    id_keys = F.filter(F.transform(query_pairs(url), lambda p: F.lower(p["key"])), lambda k: k.rlike("^(?:" + "|".join(rules.ID_KEYS) + r")\z"))

    def by_path(lowered: Column) -> Column:
        return let(
            F.filter(F.split(lowered, "/"), lambda s: s != ""),
            lambda segments: F.when(
                F.size(segments) >= 2,
                F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), F.size(segments) - 1), "/"), F.lit("/*")),
            )
            .when(F.size(segments) == 0, F.when(lowered == "", F.lit("/")).otherwise(lowered))
            .when(F.get(segments, F.lit(0)).rlike(r"^\d+$"), F.lit("/{num}"))
            .otherwise(F.lit("/{slug}")),
        )

    return let(
        id_keys,
        lambda keys: F.when(
            F.size(keys) > 0, F.concat(F.lower(path(url)), F.lit("?"), F.array_join(F.array_sort(keys), ","))
        ).otherwise(let(F.lower(path(url)), by_path)),
    )


def page_number(url: Column | str) -> Column:
    """First numeric page parameter, else ``/page/N`` at the end of the path."""
    numeric = F.filter(query_pairs(url), lambda p: is_page_param(p["key"]) & p["value"].rlike(r"^\d+$"))
    from_path = F.regexp_extract(path(url), PAGE_IN_PATH, 1)
    return F.coalesce(F.get(numeric, F.lit(0))["value"].try_cast("bigint"), from_path.try_cast("bigint"))


def page_series(url: Column | str) -> Column:
    """What the pages of one listing share: host, path with ``{page}``, other parameters sorted."""
    others = F.transform(
        F.filter(query_pairs(url), lambda p: ~is_page_param(p["key"])),
        lambda p: F.struct(F.lower(p["key"]).alias("key"), p["value"].alias("value")),
    )
    return F.struct(
        host_key(url).alias("host"),
        F.regexp_replace(F.lower(path(url)), PAGE_IN_PATH, "/page/{page}").alias("path"),
        F.array_sort(others).alias("params"),
    )


def query_page_url(url: Column | str, param: Column | str, number: Column) -> Column:
    """The same URL with the page parameter set to a number."""
    param = F.lit(param) if isinstance(param, str) else param
    others = F.filter(query_pairs(url), lambda p: F.lower(p["key"]) != F.lower(param))
    pairs = F.concat(others, F.array(F.struct(param.alias("key"), number.cast("string").alias("value"))))
    return join_parts(scheme(url), netloc(url), full_path(url), _encode_pairs(pairs))


def path_page_url(url: Column | str, number: Column) -> Column:
    tail = F.concat(F.lit("/page/"), number.cast("string"))
    current = path(url)
    new = F.when(
        current.rlike(PAGE_IN_PATH), F.concat(F.regexp_replace(current, PAGE_IN_PATH, ""), tail)
    ).otherwise(F.concat(F.regexp_replace(current, "/+$", ""), tail))
    return join_parts(scheme(url), netloc(url), new, query(url))


def lookup_url(url: Column | str) -> Column:
    """Root of the site where the URL has a path or query."""
    return F.coalesce(
        let(
            normalize_http_url(url),
            lambda u: F.when(
                ~path(u).isin("", "/") | (query(u) != ""), F.concat(scheme(u), F.lit("://"), netloc(u), F.lit("/"))
            ).otherwise(u),
        ),
        _col(url),
    )


def _without_dots(merged: Column) -> Column:
    """Dot segments out, empty inner segments out."""

    def joined(parts: Column) -> Column:
        count = F.size(parts)
        inner = F.filter(parts, lambda s, i: (s != "") | (i == 0) | (i == count - 1))
        kept = F.aggregate(
            inner,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return F.array_join(F.concat(kept, tail), "/")

    return F.coalesce(F.nullif(let(merged, joined), F.lit("")), F.lit("/"))


def join_url(base: Column | str, raw: Column | str) -> Column:
    """Resolve a reference against a base URL (RFC 3986, section 5.2)."""
    base = _col(base)

    def resolved(ref: Column) -> Column:
        folder = F.regexp_replace(full_path(base), "[^/]*$", "")
        merged = F.when(full_path(ref).startswith("/"), full_path(ref)).otherwise(F.concat(folder, full_path(ref)))
        same_document = full_path(ref) == ""
        return (
            F.when(ref == "", base)
            .when((scheme(ref) != "") & (scheme(ref) != scheme(base)), ref)
            .when(netloc(ref) != "", join_parts(scheme(base), netloc(ref), full_path(ref), query(ref), fragment(ref)))
            .when(
                same_document,
                join_parts(
                    scheme(base), netloc(base), full_path(base),
                    F.when(query(ref) == "", query(base)).otherwise(query(ref)), fragment(ref),
                ),
            )
            .otherwise(
                join_parts(
                    scheme(base), netloc(base), _without_dots(F.split(merged, "/")), query(ref), fragment(ref)
                )
            )
        )

    return let(tidy(raw), resolved)


def resolve_url(base: Column | str, raw: Column | str) -> Column:
    """``join_url`` then ``normalize_http_url``."""
    return normalize_http_url(join_url(base, raw))


def resolve_target(base: Column | str, raw: Column | str) -> Column:
    """As ``resolve_url`` for targets of actions: no script, mail, phone or fragment; bare hosts get https."""

    def target(clean: Column) -> Column:
        bare = (
            ~clean.contains("://") & ~clean.rlike("^[/?]") & ~clean.contains(" ") & clean.rlike(r"^[^/]*\.")
        )
        return F.when(bare, F.concat(F.lit("https://"), clean)).otherwise(clean)

    blocked = r"(?i)^(?:\s*$|javascript:|mailto:|tel:|#)"
    clean = F.regexp_replace(_col(raw), r"(?U)^\s+|\s+$", "")
    return let(clean, lambda c: F.when(~c.rlike(blocked), resolve_url(base, let(c, target))))


def _version_prefix(seed: Column) -> Column:
    first = F.coalesce(F.get(path_segments(seed), F.lit(0)), F.lit(""))
    return F.when(first.rlike(r"^\d+(?:_\d+)+$"), F.concat(F.lit("/"), first)).otherwise("")


def _gallery_url(seed: Column, path_: str, query_: Column) -> Column:
    return join_parts(scheme(seed), netloc(seed), F.concat(_version_prefix(seed), F.lit(path_)), query_)


def gallery_profile_url(seed: Column | str, exhibitor_id: Column | str) -> Column:
    return _gallery_url(
        _col(seed), "/exhibitor/exhibitor-details.cfm", F.concat(F.lit("exhid="), F.url_encode(_col(exhibitor_id)))
    )


def floorplan_profile_url(seed: Column | str, exhibitor_id: Column | str) -> Column:
    seed = _col(seed)
    return join_parts(
        scheme(seed), netloc(seed), full_path(seed), query(seed),
        F.concat(F.lit("exhibitor="), quote(_col(exhibitor_id))),
    )


def app_profile_url(seed: Column | str, event_slug: Column, exhibitor_id: Column) -> Column:
    seed = _col(seed)
    return join_parts(
        scheme(seed), netloc(seed),
        F.concat(F.lit("/event/"), quote(event_slug), F.lit("/exhibitor/"), quote(exhibitor_id)), F.lit(""),
    )


def quote(text: Column) -> Column:
    """Percent-encoding in which a space is %20 and ``~`` stays."""
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def search_url(seed: Column | str, start: Column, size: Column) -> Column:
    """Search endpoint of a gallery with the allowed filters of the seed."""
    seed = _col(seed)
    filters = F.filter(
        query_pairs(seed), lambda p: F.lower(p["key"]).isin(rules.GALLERY_FILTER_PARAMS) & (p["value"] != "")
    )
    fixed = F.concat(
        F.lit("action=search&searchtype=exhibitorgallery&searchsize="), size.cast("string"),
        F.lit("&start="), start.cast("string"),
    )
    return _gallery_url(
        seed, "/ajax/remote-proxy.cfm",
        F.concat(fixed, F.when(F.size(filters) > 0, F.concat(F.lit("&"), _encode_pairs(filters))).otherwise("")),
    )


def text_fragment_url(page: Column | str, name: Column, booth: Column) -> Column:
    """Synthetic profile URL of an entry that links nowhere."""
    from stallworks.functions.text import slug

    mark = F.array_join(F.filter(F.array(slug(booth), slug(name)), lambda s: s != ""), "-")
    mark = F.coalesce(F.nullif(mark, F.lit("")), F.lit("company"))
    return let(
        F.coalesce(normalize_http_url(page), _col(page)),
        lambda base: join_parts(
            scheme(base), netloc(base), full_path(base),
            _encode_pairs(F.filter(query_pairs(base), lambda p: ~is_page_param(p["key"]))), mark,
        ),
    )


def split_borders(text: Column) -> Column:
    """A space at each border of case or between digits and letters."""
    out = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    out = F.regexp_replace(out, "([0-9])([A-Za-z])", "$1 $2")
    return F.regexp_replace(out, "([A-Za-z])([0-9])", "$1 $2")


def infer_name_from_url(url: Column | str) -> Column:
    """A readable name from the first label of the host."""
    from stallworks.functions.text import fix_lower_case, normalize_text

    label = F.substring_index(host_key(url), ".", 1)
    prefix = "^(?:" + "|".join(rules.HOST_LABEL_PREFIXES) + ")(.{3,})$"
    bare = F.when(label.rlike(prefix), F.regexp_extract(label, prefix, 1)).otherwise(label)
    return fix_lower_case(normalize_text(split_borders(F.regexp_replace(bare, "[-_]", " "))))


def line_url(line: Column | str) -> Column:
    """First URL-like token of a text line, '' without one."""
    token = F.regexp_extract(_col(line), rules.LINE_URL, 0)
    full = F.when(token.rlike("^https?://"), token).otherwise(F.concat(F.lit("https://"), token))
    return F.coalesce(F.when(token != "", normalize_http_url(full)), F.lit(""))


def ajax_total_pages(limit: Column, total: Column) -> Column:
    return F.when((limit <= 0) | (total <= 0), F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.ceil(total / limit).cast("int"))
    )


def ajax_offset(limit: Column, next_offset: Column, page: Column) -> Column:
    base = F.when(next_offset > 0, next_offset).otherwise(limit)
    return F.when(page <= 1, F.lit(0)).otherwise(base + (page - 2) * limit)
