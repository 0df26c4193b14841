"""Text expressions: names, labels, places."""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column, functions as F

from stallworks import rules
from stallworks.functions.binding import let
from stallworks.functions.url import _col, any_of, split_borders

# Names that stand without a semicolon, longest first; all names come from the standard library's HTML5 table.
_ALL_NAMES = json.dumps(html5)
_COMMON = ["amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;", "ndash;", "mdash;", "rsquo;", "lsquo;", "hellip;", "reg;", "trade;", "copy;", "eacute;"]
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
ENTITY = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:" + "|".join(_BARE) + "))"


def _legacy_codes() -> dict[int, int]:
    """Codes 128 to 159 mean Windows letters where that code page has one."""
    held = {}
    for code in range(128, 160):
        try:
            held[code] = ord(bytes([code]).decode("cp1252"))
        except UnicodeDecodeError:
            continue
    return held


def _code_point(code: Column) -> Column:
    """The character of a code; U+FFFD for 0, surrogates and codes beyond Unicode."""
    legacy = F.create_map(*(F.lit(x) for pair in _legacy_codes().items() for x in pair))
    code = F.coalesce(F.try_element_at(legacy, code.try_cast("int")), code.try_cast("int"), F.lit(0))
    bad = (code <= 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(code).cast("long")), 8, "0")), "UTF-32")


def _entity(entity: Column) -> Column:
    """What one entity stands for; an unknown name stays as it is."""
    body = F.regexp_replace(entity, "^&|;$", "")
    digits = F.when(F.length(body) <= 9, F.substring(body, 2, 9)).otherwise("9999999")
    hexed = F.when(F.length(body) <= 9, F.conv(F.substring(body, 3, 9), 16, 10)).otherwise("9999999")
    common = F.create_map(*(F.lit(x) for name in _COMMON for x in (name, html5[name])))
    names = F.from_json(F.lit(_ALL_NAMES), "map<string,string>")  # searched one by one: only for what is not common
    name = F.substr(entity, F.lit(2))
    return (
        F.when(body.rlike("^#[xX]"), _code_point(hexed.try_cast("bigint")))
        .when(body.startswith("#"), _code_point(digits.try_cast("bigint")))
        .otherwise(F.coalesce(F.try_element_at(common, name), F.try_element_at(names, name), entity))
    )


def unescape(text: Column | str) -> Column:
    """All HTML5 names and numeric forms, each once: what comes out is not looked at again."""

    def replaced(value: Column) -> Column:
        between = F.split(value, ENTITY, -1)
        found = F.regexp_extract_all(value, F.lit(ENTITY), F.lit(0))
        parts = F.zip_with(between, found, lambda a, e: F.concat(a, F.when(e.isNull(), "").otherwise(_entity(e))))
        return F.when(value.contains("&"), F.array_join(parts, "")).otherwise(value)

    return let(_col(text), replaced)


def normalize_text(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def canonical_label(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(normalize_text(text)), "[^a-z0-9]+", " "))


def canonical_key(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(normalize_text(text)), "[^a-z0-9]+", "")


def slug(text: Column | str, sep: str = "_", limit: int | None = 80) -> Column:
    ends = f"^{sep}+|{sep}+$"
    out = F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", sep), ends, "")
    return out if limit is None else F.regexp_replace(F.substring(out, 1, limit), ends, "")


def positive_int(text: Column | str) -> Column:
    return F.coalesce(F.regexp_replace(_col(text), "[^0-9]", "").try_cast("bigint"), F.lit(0))


def strip_tags(html: Column | str) -> Column:
    return normalize_text(F.regexp_replace(unescape(html), "<[^>]+>", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def is_lower_cased(text: Column) -> Column:
    return (text == F.lower(text)) & (text != F.upper(text))


def is_upper_cased(text: Column) -> Column:
    return (text == F.upper(text)) & (text != F.lower(text))


def fix_lower_case(text: Column) -> Column:
    """All-lower text: a short single word becomes an acronym, others get capitals."""

    def fixed(value: Column) -> Column:
        short = ~value.contains(" ") & (F.length(value) <= 4)
        return (
            F.when(~is_lower_cased(value), value).when(short, F.upper(value)).otherwise(F.initcap(value))
        )

    return let(text, fixed)


def clean_company_name(text: Column | str) -> Column:
    """A display name without interface noise, logo words, counters and trailing regions."""
    out = F.regexp_replace(unescape(F.coalesce(_col(text), F.lit(""))), rules.UI_NOISE, "")
    out = F.regexp_replace(out, "(?i)logo$", " ")
    out = F.regexp_replace(out, r"(?i)\b" + any_of(rules.LOGO_MARKERS) + r"\b", " ")
    out = F.regexp_replace(out, r"\(\d+\)$", " ")
    out = normalize_text(F.regexp_replace(out, r"\s+\d{2,}\s*$", " "))
    region = r"(?i)(?:(?:^| )[^A-Za-z0-9 ]*" + any_of(rules.REGION_WORDS) + r"[^A-Za-z0-9 ]*)+$"
    return fix_lower_case(F.regexp_replace(out, region, ""))


def clean_media_stem(text: Column | str) -> Column:
    """File name to words."""
    name = F.coalesce(F.try_url_decode(F.replace(_col(text), F.lit("+"), F.lit("%2B"))), _col(text), F.lit(""))
    name = F.regexp_extract(name, r"([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")
    out = split_borders(F.regexp_replace(stem, "[-_.]", " "))
    out = F.regexp_replace(out, "(?i)logo$", " ")
    out = F.regexp_replace(out, r"(?i)\b(?:logo|monogram|stacked|square|final|new|hr|butternut)\b", " ")
    return normalize_text(F.regexp_replace(out, r"\s+\d{2,}\s*$", " "))


def is_companyish(text: Column | str) -> Column:
    """Could this text be the name of a company?"""

    def judged(name: Column) -> Column:
        lowered = F.lower(name)
        letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
        digits = F.length(F.regexp_replace(name, r"[^\p{Nd}]", ""))
        compact = F.replace(name, F.lit(" "))
        code = (
            (letters >= 1) & (digits >= 1) & F.length(compact).between(3, 10)
            & compact.rlike("^[A-Za-z0-9.+&_-]+$") & (F.upper(compact) == compact)
        )
        return (
            F.length(name).between(2, 140)
            & name.rlike("[A-Za-z]")
            & ~is_one_of(lowered, rules.GENERIC_LINK_TEXTS + rules.PROFILE_LABELS + rules.PAGINATION_TEXTS)
            & ~lowered.rlike(r"^page \d+$")
            & (F.size(words(name)) <= 20)
            & ((letters >= 2) | code)
        )

    return let(normalize_text(F.coalesce(_col(text), F.lit(""))), judged)


def is_machine_name(text: Column | str) -> Column:
    """Generated names: hashes, counters, camera files."""

    def judged(label: Column) -> Column:
        compact = F.replace(label, F.lit(" "))
        digits = F.length(F.regexp_replace(compact, "[^0-9]", ""))
        return (
            (label == "")
            | label.rlike(r"^(?:image(?: \d+)?|untitled design(?: \d+)?|\d+)$")
            | label.contains("mv 2")
            | compact.startswith("924723")
            | compact.rlike(r"^(?:[a-f0-9]{6,}|\d[\da-f ]{8,})$")
            | ((digits >= 6) & (F.length(compact) >= 12))
        )

    return let(canonical_label(text), judged)


def is_low_confidence_name(text: Column | str) -> Column:
    """A name that the company's own site should replace."""

    def judged(name: Column) -> Column:
        parts = words(name)
        first, last = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
        return (
            is_machine_name(name)
            | (F.size(parts) == 0)
            | F.forall(parts, lambda w: F.length(w) <= 2)
            | canonical_label(name).rlike(any_of(rules.LOGO_MARKERS))
            | name.rlike(r"\(\d+\)$")
            | F.coalesce((F.size(parts) == 2) & last.rlike(r"^\d+$"), F.lit(False))
            | F.coalesce((F.size(parts) == 1) & (F.length(first) >= 4) & ~is_upper_cased(first), F.lit(False))
        )

    return let(clean_company_name(text), judged)


def is_generic_directory_label(text: Column | str) -> Column:
    return let(
        canonical_label(text),
        lambda label: (label == "")
        | is_one_of(label, rules.DIRECTORY_LABELS)
        | (label.contains("directory") & label.rlike(any_of(rules.DIRECTORY_LABEL_WORDS))),
    )


def is_richtext_company_line(text: Column | str) -> Column:
    return let(
        clean_company_name(text),
        lambda name: (name != "")
        & is_companyish(name)
        & ~canonical_label(name).rlike(any_of(rules.CALL_TO_ACTION_MARKERS)),
    )


def brand_tokens(text: Column | str) -> Column:
    return F.filter(
        words(canonical_label(clean_company_name(text))),
        lambda t: (F.length(t) >= 3) & ~is_one_of(t, rules.DOMAIN_STOPWORDS) & ~t.rlike(r"^\d+$"),
    )


def brand_acronym(text: Column | str) -> Column:
    return acronym_of(brand_tokens(text))


def acronym_of(tokens: Column) -> Column:
    return let(
        tokens,
        lambda ts: F.when(
            F.size(ts) >= 2, F.array_join(F.transform(ts, lambda t: F.substring(t, 1, 1)), "")
        ).otherwise(""),
    )


def brand_key(text: Column | str) -> Column:
    """Name tokens in one string, without site words and trailing regions."""
    label = canonical_label(clean_company_name(text))
    kept = F.array_join(F.filter(words(label), lambda t: ~is_one_of(t, rules.SITE_WORDS)), " ")
    bare = F.regexp_replace(kept, "(?:(?:^| )" + any_of(rules.REGION_WORDS) + ")+$", "")
    return F.replace(bare, F.lit(" "))


def split_title(text: Column | str) -> Column:
    return F.filter(
        F.transform(F.split(_col(text), rules.TITLE_SPLIT), normalize_text), lambda part: part != ""
    )


def distinct_texts(values: Column) -> Column:
    """Case-insensitive distinct, first spelling and order kept."""
    clean = F.filter(F.transform(values, normalize_text), lambda v: v != "")
    return let(
        clean,
        lambda texts: F.filter(
            texts, lambda v, i: F.array_position(F.transform(texts, F.lower), F.lower(v)) == i + 1
        ),
    )


def brandish_candidates(text: Column | str) -> Column:
    """The cleaned text and what stands behind " by " or " from "."""

    def candidates(name: Column) -> Column:
        def tail(marker: str) -> Column:
            at = F.instr(F.lower(name), marker)
            return F.when(at > 0, clean_company_name(F.substr(name, at + F.lit(len(marker))))).otherwise("")

        found = distinct_texts(F.array(name, tail(" by "), tail(" from ")))
        return F.when(name == "", F.array().cast("array<string>")).otherwise(found)

    return let(clean_company_name(text), candidates)


def booth_and_name(text: Column | str) -> Column:
    """struct(name, booth) of a short card text; both '' where it names no company."""

    def parts(short: Column) -> Column:
        has_booth = short.rlike(rules.BOOTH_CODE)
        booth = F.when(has_booth, normalize_text(F.regexp_extract(short, rules.BOOTH_CODE, 1))).otherwise("")
        name = F.when(has_booth, F.regexp_extract(short, rules.BOOTH_CODE, 2)).otherwise(short)
        allowed = (short != "") & ~F.lower(short).rlike(any_of(rules.FILTER_UI_MARKERS))
        return F.struct(F.when(allowed, clean_company_name(name)).otherwise("").alias("name"), booth.alias("booth"))

    def checked(pair: Column) -> Column:
        name = pair["name"]
        good = (
            (name != "") & (F.size(words(name)) <= 10) & ~is_generic_directory_label(name) & is_companyish(name)
        )
        nothing = F.struct(F.lit("").alias("name"), F.lit("").alias("booth"))
        return F.when(good, pair).otherwise(nothing)

    def shortened(raw: Column) -> Column:
        short = F.regexp_replace(raw, rules.BOOTH_NOISE, "")
        short = normalize_text(F.regexp_replace(short, r"^[ \-|,]+|[ \-|,]+$", ""))
        return F.when(F.length(raw) <= rules.SHORT_TEXT, short).otherwise("")

    raw = normalize_text(F.coalesce(_col(text), F.lit("")))
    return let(let(let(raw, shortened), parts), checked)


def region_map() -> Column:
    return F.create_map(*[F.lit(item) for pair in rules.REGIONS.items() for item in pair])


def region_abbr(text: Column | str) -> Column:
    """Two-letter region, '' where unknown."""
    known = sorted(set(rules.REGIONS.values()))
    return let(
        canonical_label(text),
        lambda label: F.when(
            is_one_of(F.upper(F.replace(label, F.lit(" "))), known), F.upper(F.replace(label, F.lit(" ")))
        ).otherwise(F.coalesce(F.try_element_at(region_map(), label), F.lit(""))),
    )


def location_city(text: Column | str) -> Column:
    return let(
        F.regexp_replace(normalize_text(text), "^[ ,]+|[ ,]+$", ""),
        lambda city: F.when(is_upper_cased(city) | is_lower_cased(city), F.initcap(city)).otherwise(city),
    )


def city_region_hits(text: Column | str) -> Column:
    """All matches as struct(hit, city, region), in order, repeats kept."""
    hits = F.regexp_extract_all(_col(text), F.lit(rules.CITY_REGION), F.lit(0))
    pairs = F.transform(
        hits,
        lambda h: F.struct(
            h.alias("hit"),
            location_city(F.regexp_extract(h, rules.CITY_REGION, 1)).alias("city"),
            region_abbr(F.regexp_extract(h, rules.CITY_REGION, 2)).alias("region"),
        ),
    )
    return F.filter(pairs, lambda p: (p["city"] != "") & (p["region"] != ""))


def city_region_pairs(text: Column | str) -> Column:
    """Distinct (city, region) structs in order of first appearance."""

    def key(pair: Column) -> Column:
        return F.concat_ws("|", F.lower(pair["city"]), pair["region"])

    found = F.transform(
        city_region_hits(text), lambda p: F.struct(p["city"].alias("city"), p["region"].alias("region"))
    )
    return let(
        found,
        lambda pairs: F.filter(
            pairs, lambda p, i: F.array_position(F.transform(pairs, key), key(p)) == i + 1
        ),
    )


def conference_score(text: Column | str) -> Column:
    """NULL for labels that name no event."""

    def score(name: Column) -> Column:
        hints = let(
            canonical_label(name),
            lambda label: sum((F.when(label.contains(w), 12).otherwise(0) for w in rules.EVENT_WORDS), F.lit(0)),
        )
        total = (
            F.length(name) + hints
            - F.when(F.size(words(name)) <= 1, 8).otherwise(0)
            - F.when(F.length(name) > 60, 10).otherwise(0)
        )
        return F.when((name != "") & ~is_generic_directory_label(name), total.cast("double"))

    return let(normalize_text(text), score)


def best_conference_text(candidates: Column) -> Column:
    """Candidate of the highest score, the first of equals; NULL when none scores."""
    scored = F.transform(
        candidates, lambda c, i: F.struct(conference_score(c).alias("score"), (-i).alias("place"), c.alias("text"))
    )
    return F.array_max(F.filter(scored, lambda s: s["score"].isNotNull()))["text"]


def conference_label(text: Column | str) -> Column:
    """Name of the event without directory and search words."""

    def cleaned(value: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(value, rules.CONFERENCE_DIRECTORY, ""), rules.CONFERENCE_NOISE, "")
        return F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), r"^[ \-|:,]+|[ \-|:,]+$", "")

    def best(name: Column) -> Column:
        candidates = F.filter(F.transform(F.concat(F.array(name), split_title(name)), cleaned), lambda c: c != "")
        return F.coalesce(best_conference_text(candidates), cleaned(name))

    return let(normalize_text(F.coalesce(_col(text), F.lit(""))), best)


def error_summary(text: Column | str) -> Column:
    """One plain sentence for an error text."""
    text = F.coalesce(_col(text), F.lit(""))
    low = F.lower(text)
    compact = normalize_text(text)
    unread = low.contains("could not infer company/profile links")
    no_browser = low.contains("browser fallback is unavailable")
    return (
        F.when(text == "", F.lit(""))
        .when(
            low.contains("could not resolve host") | low.contains("nodename nor servname provided"),
            "An earlier worker run could not reach the site over the network. Retry the show now.",
        )
        .when(
            low.contains("too many requests") | low.contains("http 429"),
            "Clay throttled the upload after the scrape finished. Retry later to resend the export.",
        )
        .when(
            unread & no_browser,
            "This source failed before browser rendering was enabled. Retry now with browser support turned on.",
        )
        .when(unread, "We reached the site, but the exhibitor layout still needs a source-specific extractor.")
        .when(
            no_browser,
            "This event site may require browser rendering. Retry now that browser support is installed.",
        )
        .when(F.length(compact) > 170, F.concat(F.substring(compact, 1, 167), F.lit("...")))
        .otherwise(compact)
    )


def display_text(text: Column, title: Column, label: Column) -> Column:
    """First non-empty of text, title and label."""
    parts = [F.nullif(normalize_text(part), F.lit("")) for part in (text, title, label)]
    return F.coalesce(*parts, F.lit(""))


def is_one_of(text: Column, words_: list[str]) -> Column:
    """Membership in a word list, as one pattern: one node in the plan instead of one per word."""
    return text.rlike(r"^(?:" + pattern_of(words_) + r")\z")


def contains_any(text: Column, markers: list[str]) -> Column:
    return text.rlike(any_of(markers))


def pattern_of(words_: list[str]) -> str:
    return "|".join(re.escape(word) for word in words_)
