"""SQL fragments for the DuckDB twins: the same rules, written again in SQL."""

from __future__ import annotations

from stallworks import rules


def alternatives(words: list[str]) -> str:
    special = ".+*?()[]{}|^$"
    return "|".join("".join("\\" + c if c in special else c for c in w) for w in words).replace("'", "''")


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{00a0}}]+', ' ', 'g'))"


def label(x: str) -> str:
    return f"trim(regexp_replace(lower({norm(x)}), '[^a-z0-9]+', ' ', 'g'))"


def host(u: str) -> str:
    return f"regexp_replace(lower(regexp_extract(trim({u}), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"


def path(u: str) -> str:
    return f"regexp_extract(trim({u}), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def query(u: str) -> str:
    return f"regexp_extract(trim({u}), '^[^?#]*\\?([^#]*)', 1)"


def normalized(u: str) -> str:
    t = f"trim({u})"
    return (
        f"CASE WHEN regexp_matches({t}, '^(?i:https?)://[^/?#]') THEN "
        f"concat(lower(regexp_extract({t}, '^([a-zA-Z]+)://', 1)), '://', regexp_extract({t}, '^[a-zA-Z]+://([^/?#]*)', 1), "
        f"{path(u)}, CASE WHEN {query(u)} <> '' THEN concat('?', {query(u)}) ELSE '' END) END"
    )


def pairs(u: str) -> str:
    """List of raw key=value parts."""
    return f"list_filter(string_split({query(u)}, '&'), lambda p: p <> '')"


def page_param(k: str) -> str:
    return f"regexp_matches(lower({k}), '^(?:{alternatives(rules.PAGE_PARAMS)})$|_page$|_page_num$')"


def page_number(u: str) -> str:
    numeric = (
        f"list_filter({pairs(u)}, lambda p: {page_param('split_part(p, chr(61), 1)')} "
        f"AND regexp_matches(split_part(p, chr(61), 2), '^[0-9]+$'))"
    )
    return (
        f"coalesce(CAST(split_part({numeric}[1], chr(61), 2) AS BIGINT), "
        f"TRY_CAST(nullif(regexp_extract({path(u)}, '(?i)/page/([0-9]+)/?$', 1), '') AS BIGINT))"
    )


def url_group(u: str) -> str:
    ids = alternatives(rules.ID_KEYS)
    keys = f"list_sort(list_filter(list_transform({pairs(u)}, lambda p: lower(split_part(p, chr(61), 1))), lambda k: regexp_matches(k, '^(?:{ids})$')))"
    segs = f"list_filter(string_split(lower({path(u)}), '/'), lambda s: s <> '')"
    return (
        f"CASE WHEN len({keys}) > 0 THEN concat(lower({path(u)}), '?', array_to_string({keys}, ',')) "
        f"WHEN len({segs}) >= 2 THEN concat('/', array_to_string({segs}[1:len({segs}) - 1], '/'), '/*') "
        f"WHEN len({segs}) = 1 AND regexp_matches({segs}[1], '^[0-9]+$') THEN '/{{num}}' "
        f"WHEN len({segs}) = 1 THEN '/{{slug}}' WHEN {path(u)} = '' THEN '/' ELSE lower({path(u)}) END"
    )


def initcap(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')"


def fix_lower(x: str) -> str:
    return (
        f"CASE WHEN {x} = lower({x}) AND {x} <> upper({x}) THEN CASE WHEN NOT contains({x}, ' ') AND length({x}) <= 4 "
        f"THEN upper({x}) ELSE {initcap(x)} END ELSE {x} END"
    )


def scrubbed(x: str) -> str:
    """A name before its letter case is fixed."""
    ui = rules.UI_NOISE.replace("'", "''")
    out = f"regexp_replace(replace({x}, '&amp;', '&'), '{ui}', '')"
    out = f"regexp_replace({out}, '(?i)logo$', ' ')"
    out = f"regexp_replace({out}, '(?i)\\b(?:logo|monogram|stacked|square)\\b', ' ', 'g')"
    out = f"regexp_replace({out}, '\\([0-9]+\\)$', ' ')"
    out = norm(f"regexp_replace({out}, '\\s+[0-9]{{2,}}\\s*$', ' ')")
    region = alternatives(rules.REGION_WORDS)
    return f"regexp_replace({out}, '(?i)(?:(?:^| )[^A-Za-z0-9 ]*(?:{region})[^A-Za-z0-9 ]*)+$', '')"


def companyish(t: str) -> str:
    """For an already normalised text."""
    stop = alternatives(rules.GENERIC_LINK_TEXTS + rules.PROFILE_LABELS + rules.PAGINATION_TEXTS)
    letters = f"length(regexp_replace({t}, '[^\\pL]', '', 'g'))"
    digits = f"length(regexp_replace({t}, '[^\\p{{Nd}}]', '', 'g'))"
    compact = f"replace({t}, ' ', '')"
    return (
        f"(length({t}) BETWEEN 2 AND 140 AND regexp_matches({t}, '[A-Za-z]') "
        f"AND NOT regexp_matches(lower({t}), '^(?:{stop})$') AND NOT regexp_matches(lower({t}), '^page [0-9]+$') "
        f"AND len(list_filter(string_split({t}, ' '), lambda w: w <> '')) <= 20 "
        f"AND ({letters} >= 2 OR ({letters} >= 1 AND {digits} >= 1 AND length({compact}) BETWEEN 3 AND 10 "
        f"AND regexp_matches({compact}, '^[A-Za-z0-9.+&_-]+$') AND upper({compact}) = {compact})))"
    )


def machine_name(lbl: str) -> str:
    compact = f"replace({lbl}, ' ', '')"
    return (
        f"({lbl} = '' OR regexp_matches({lbl}, '^(?:image(?: [0-9]+)?|untitled design(?: [0-9]+)?|[0-9]+)$') "
        f"OR contains({lbl}, 'mv 2') OR starts_with({compact}, '924723') "
        f"OR regexp_matches({compact}, '^(?:[a-f0-9]{{6,}}|[0-9][0-9a-f ]{{8,}})$') "
        f"OR (length(regexp_replace({compact}, '[^0-9]', '', 'g')) >= 6 AND length({compact}) >= 12))"
    )


def brand_tokens(lbl: str) -> str:
    stop = alternatives(rules.DOMAIN_STOPWORDS)
    return (
        f"list_filter(string_split({lbl}, ' '), lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^(?:{stop})$') "
        f"AND NOT regexp_matches(t, '^[0-9]+$'))"
    )


def brand_key(lbl: str) -> str:
    site, region = alternatives(rules.SITE_WORDS), alternatives(rules.REGION_WORDS)
    kept = f"array_to_string(list_filter(string_split({lbl}, ' '), lambda t: NOT regexp_matches(t, '^(?:{site})$')), ' ')"
    return f"replace(regexp_replace({kept}, '(?:(?:^| )(?:{region}))+$', ''), ' ', '')"


def generic_label(lbl: str) -> str:
    return (
        f"({lbl} = '' OR regexp_matches({lbl}, '^(?:{alternatives(rules.DIRECTORY_LABELS)})$') OR (contains({lbl}, 'directory') "
        f"AND regexp_matches({lbl}, '{alternatives(rules.DIRECTORY_LABEL_WORDS)}')))"
    )


def conference_score(n: str) -> str:
    """Score of a normalised text, NULL when it names no event."""
    lbl = label(n)
    hints = " + ".join(f"CASE WHEN contains({lbl}, '{w}') THEN 12 ELSE 0 END" for w in rules.EVENT_WORDS)
    words = f"len(list_filter(string_split({n}, ' '), lambda w: w <> ''))"
    return (
        f"CASE WHEN {n} <> '' AND NOT {generic_label(lbl)} THEN CAST(length({n}) + {hints} - CASE WHEN {words} <= 1 THEN 8 ELSE 0 END "
        f"- CASE WHEN length({n}) > 60 THEN 10 ELSE 0 END AS DOUBLE) END"
    )
