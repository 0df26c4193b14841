"""SQL twins (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

from stallworks.llm import line_dedup, mixing, quality_rules as Q, url_trust

WORD = "[^\\x20\\x09-\\x0D]+"

SECRETS = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner,
    coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents),
-- a pattern cuts the text into pieces and matches in turn; lengths so far give the places
cut AS (
    SELECT r, owner, kind, m, regexp_split_to_array(text, p) AS gaps, v FROM (
        SELECT r, owner, text, 0 AS kind, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+' AS p,
               regexp_extract_all(text, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+') AS m,
               regexp_extract_all(text, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS v
        FROM docs
        UNION ALL SELECT r, owner, text, 1, 'AKIA[A-Z0-9]+', regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM docs
        UNION ALL SELECT r, owner, text, 2, '[0-9a-f]{24,}', regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}') FROM docs
    ) WHERE len(m) > 0
),
base AS (
    SELECT r, owner, kind, m[i] AS m, v[i] AS v,
           list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cut)
),
held AS (
    SELECT r, owner, kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e, v FROM base
    WHERE CASE kind WHEN 0 THEN length(v) >= 6 WHEN 1 THEN length(m) >= 20 ELSE true END
),
words AS (
    SELECT r, owner, m[i] AS v,
           list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT r, owner, regexp_extract_all(text, '[A-Za-z0-9+/_=-]+') AS m, regexp_split_to_array(text, '[A-Za-z0-9+/_=-]+') AS gaps
        FROM docs WHERE regexp_matches(text, '[A-Za-z0-9+/_=-]{20,}')))
),
spread AS (
    SELECT v, -sum(c / length(v) * log2(c / length(v))) AS entropy
    FROM (SELECT v, ch, CAST(count(*) AS DOUBLE) AS c FROM (
        SELECT v, unnest(string_split(v, '')) AS ch FROM (SELECT v FROM held UNION SELECT v FROM words WHERE length(v) >= 20)
    ) GROUP BY v, ch) GROUP BY v
),
live AS (SELECT v, entropy >= 3.0 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AS live FROM spread),
found AS (
    SELECT r, owner, kind, s, e, v FROM held
    UNION ALL
    SELECT w.r, w.owner, 3, CAST(w.s AS BIGINT), CAST(w.s + length(w.v) AS BIGINT), w.v FROM words w JOIN live USING (v)
    WHERE live AND length(w.v) >= 20
      AND NOT EXISTS (SELECT 1 FROM held h WHERE h.r = w.r AND h.s < w.s + length(w.v) AND h.e > w.s)
),
owners AS (SELECT v, count(DISTINCT owner) >= 3 AND count(DISTINCT owner || chr(0) || repo) >= 4 AS copied FROM found JOIN docs USING (r, owner) GROUP BY v),
marked AS (
    SELECT f.*, live, copied, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || s || ':' || e AS span
    FROM found f JOIN live USING (v) JOIN owners USING (v)
),
per_doc AS (
    SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
           coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base,
           coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3 OR NOT copied), '') AS spans,
           count(*) FILTER (kind = 3 AND NOT copied) AS n_token, count(*) FILTER (live AND NOT copied) AS n_live,
           count(*) FILTER (copied) AS n_copied
    FROM marked GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_token, 0) AS n_token,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs LEFT JOIN per_doc USING (r)
"""


def _posterior(k: int, table: str) -> tuple[str, str]:
    """Likelihoods (bad, good) of a pattern under the rates of a one-row table."""
    bad, good = [f"{table}.prior"], [f"(1.0 - {table}.prior)"]
    for i in range(k):
        vote = f"substr(pattern, {i + 1}, 1)"
        bad.append(f"CASE {vote} WHEN 'b' THEN {table}.p{i} WHEN 'g' THEN 1.0 - {table}.p{i} ELSE 1.0 END")
        good.append(f"CASE {vote} WHEN 'b' THEN {table}.q{i} WHEN 'g' THEN 1.0 - {table}.q{i} ELSE 1.0 END")
    return " * ".join(bad), " * ".join(good)


def _em_round(k: int) -> str:
    bad, good = _posterior(k, "em")
    w = Q.PRIOR_WEIGHT
    names = ["prior", *(f"{c}{i}" for c in "pq" for i in range(k))]
    new = {"prior": f"(sum(n * b) + {w} * sum(n) * {Q.PRIOR_BAD}) / (sum(n) + {w} * sum(n))"}
    for i, rule in enumerate(Q.RULES):
        vote = f"substr(pattern, {i + 1}, 1)"
        for name, side, first, share in (("p", "b", rule[3], Q.PRIOR_BAD), ("q", "(1.0 - b)", rule[4], 1.0 - Q.PRIOR_BAD)):
            pseudo = f"{w} * sum(n) * {share}"
            new[f"{name}{i}"] = (f"(coalesce(sum(n * {side}) FILTER ({vote} = 'b'), 0) + {pseudo} * {first}) / "
                                 f"(coalesce(sum(n * {side}) FILTER ({vote} <> '-'), 0) + {pseudo})")
    old = ", ".join(f"em.{c} AS o{c}" for c in names)
    return (f"SELECT step, {', '.join(f'n{c}' for c in names)}, greatest({', '.join(f'abs(n{c} - o{c})' for c in names)}) FROM ("
            f"SELECT step + 1 AS step, {', '.join(f'o{c}' for c in names)}, {', '.join(f'{new[c]} AS n{c}' for c in names)} FROM ("
            f"SELECT pattern, n, step, {old}, 1.0 - ({good}) / (({good}) + ({bad})) AS b FROM patterns, em WHERE change >= {Q.TOLERANCE}) "
            f"GROUP BY step, {', '.join(f'o{c}' for c in names)})")


def quality() -> str:
    k = len(Q.RULES)
    votes = " || ".join(f"CASE WHEN {bad} THEN 'b' WHEN {good} THEN 'g' ELSE '-' END" for _, good, bad, *_ in Q.RULES)
    first = ", ".join([f"CAST({Q.PRIOR_BAD} AS DOUBLE) AS prior", *(f"CAST({r[3]} AS DOUBLE) AS p{i}" for i, r in enumerate(Q.RULES)),
                       *(f"CAST({r[4]} AS DOUBLE) AS q{i}" for i, r in enumerate(Q.RULES)), "CAST(1 AS DOUBLE) AS change"])
    rounds = [f"em AS (SELECT 0 AS step, {first} UNION ALL {_em_round(k)})", "settled AS MATERIALIZED (SELECT * FROM em ORDER BY step DESC LIMIT 1)"]
    bad, good = _posterior(k, "settled")
    return f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
    SELECT r, doc_id, text, regexp_extract_all(text, '{WORD}') AS words,
           list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM docs
),
grams AS (
    SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
    FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) >= 3)
),
again AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) t(d) GROUP BY r),
measured AS MATERIALIZED (
    SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
           CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
           CAST(len(lines) AS BIGINT) AS n_lines,
           length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
           length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks,
           length(text) - length(regexp_replace(text, '[.!?]', '', 'g')) AS n_stops
    FROM split LEFT JOIN covered USING (r)
),
voted AS MATERIALIZED (SELECT *, {votes} AS pattern FROM measured),
patterns AS MATERIALIZED (SELECT pattern, count(*) AS n FROM voted GROUP BY pattern),
{", ".join(rounds)},
scored AS (
    SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
           ({good}) / (({good}) + ({bad})) AS p
    FROM voted, settled
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept,
       round(p, 6) AS p_good, pattern AS votes
FROM scored
"""


def lines(ratio: float = 0.1) -> str:
    blocks = line_dedup.BLOCKS.replace("(?i)", "")
    return f"""
WITH pages_text AS MATERIALIZED (
    SELECT row_number() OVER () AS r, page_id,
           lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host,
           string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{line_dedup.HIDDEN}', '', 'g'),
               '{blocks}', chr(10), 'gi'), '{line_dedup.TAGS}', '', 'g'), chr(10)) AS lines
    FROM pages
),
each AS (SELECT r, host, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM pages_text),
-- rows of a host with one text are one page
page AS (SELECT r, min(r) OVER (PARTITION BY host, array_to_string(lines, chr(10))) AS p FROM pages_text),
counts AS (SELECT host, trim(line, ' ') AS line, count(DISTINCT p) AS n FROM each JOIN page USING (r) WHERE trim(line, ' ') <> '' GROUP BY ALL),
sizes AS (SELECT host, count(DISTINCT p) AS n FROM pages_text JOIN page USING (r) GROUP BY host),
bad AS (SELECT host, line FROM counts c JOIN sizes s USING (host) WHERE c.n >= 2 AND c.n > {ratio} * s.n),
marked AS (SELECT e.r, e.i, e.line, b.line IS NOT NULL AS bad FROM each e LEFT JOIN bad b ON b.host = e.host AND b.line = trim(e.line, ' ')),
done AS (
    SELECT r, count(*) FILTER (trim(line, ' ') <> '') AS n_lines, count(*) FILTER (bad) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad), '') AS kept
    FROM marked GROUP BY r
)
SELECT page_id, host, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM pages_text JOIN done USING (r)
"""


def mixing_sql(share: float = mixing.SHARE) -> str:
    dims = list(mixing.POWERS)
    topic = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in mixing.TOPICS) + f" ELSE '{mixing.OTHER_TOPIC}' END"
    steps = []
    for d, power in mixing.POWERS.items():
        steps.append(f"""t_{d} AS MATERIALIZED (SELECT {d}, pow(t, {power}) / sum(pow(t, {power})) OVER () AS share
            FROM (SELECT {d}, CAST(sum(tokens) AS DOUBLE) AS t FROM cells GROUP BY {d}) WHERE t > 0)""")
    moved = "SELECT * FROM rake WHERE change >= {}".format(mixing.TOLERANCE)
    for d in dims:
        moved = f"""SELECT r.* EXCLUDE (weight, m), CASE WHEN m > 0 THEN weight * (coalesce(share, 0) * (SELECT CAST(sum(tokens) AS DOUBLE) FROM cells) / m) ELSE 0 END AS weight
            FROM (SELECT *, sum(weight) OVER (PARTITION BY {d}) AS m FROM ({moved})) r LEFT JOIN t_{d} USING ({d})"""
    names = ", ".join(dims)
    steps.append(f"""rake AS (
        SELECT 0 AS step, {names}, tokens, CAST(tokens AS DOUBLE) AS weight, CAST(tokens AS DOUBLE) AS was, CAST(1 AS DOUBLE) AS change FROM cells
        UNION ALL
        SELECT step + 1, {names}, tokens, weight, weight, max(abs(weight - was)) OVER () / (SELECT CAST(sum(tokens) AS DOUBLE) FROM cells) FROM ({moved}))""")
    steps.append("raked AS MATERIALIZED (SELECT * FROM rake WHERE step = (SELECT max(step) FROM rake))")
    steps.append("ratios AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS ratio FROM raked)")
    steps.append(f"""caps AS (
        SELECT 0 AS step, CAST({share} AS DOUBLE) AS c, CAST(-1 AS HUGEINT) AS filled, true AS going
        UNION ALL
        SELECT step + 1, CASE WHEN rest > 0 AND now <> before THEN greatest(c, ({share} * total - now) / rest) ELSE c END, now, rest > 0 AND now <> before FROM (
            SELECT step, c, filled AS before, sum(tokens) AS total, CAST(sum(CASE WHEN ratio * c >= 1.0 THEN tokens ELSE 0 END) AS HUGEINT) AS now,
                   sum(CASE WHEN ratio * c >= 1.0 THEN 0 ELSE weight END) AS rest
            FROM (SELECT r.tokens, r.weight, r.ratio, k.step, k.c, k.filled FROM ratios r, caps k WHERE going) GROUP BY step, c, filled))""")
    steps.append("cap AS (SELECT c FROM caps ORDER BY step DESC LIMIT 1)")
    return f"""
WITH RECURSIVE docs AS MATERIALIZED (
    SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic,
           CAST(len(regexp_extract_all(text, '{WORD}')) AS BIGINT) AS tokens
    FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)
),
cells AS MATERIALIZED (SELECT {", ".join(dims)}, sum(tokens) AS tokens FROM docs GROUP BY ALL),
{", ".join(steps)}
SELECT doc_id, topic, d.tokens, round(ratio, 6) AS ratio, round(least(1.0, ratio * c), 6) AS p,
       ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0 < least(1.0, ratio * c) AS kept
FROM docs d JOIN ratios USING ({", ".join(dims)}), cap
"""


def urls() -> str:
    T = url_trust
    quoted = lambda text: text.replace("'", "''")

    def ruled(value: int | None) -> str:
        cases = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if value is None else v}'"
                 for h, p, v in T.ranked(T.RULES)]
        return f"CASE {' '.join(cases)} END"

    return f"""
WITH RECURSIVE cut AS MATERIALIZED (
    SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html,
           translate(regexp_extract(coalesce(url, ''), '{quoted(T.HOST)}', 1), '{T.UPPER}', '{T.LOWER}') AS host,
           regexp_extract(coalesce(url, ''), '{quoted(T.PATH)}', 1) AS path
    FROM pages
),
judged AS MATERIALIZED (SELECT *, {ruled(None)} AS rule, {ruled(1)} AS ruled FROM cut),
hosts AS (
    SELECT host, CAST(floor({T.UNIT} * count(*) FILTER (ruled = 'allow') / count(*)) AS BIGINT) AS trust,
           CAST(floor({T.UNIT} * count(*) FILTER (ruled = 'block') / count(*)) AS BIGINT) AS distrust
    FROM judged WHERE host <> '' GROUP BY host
),
family AS (
    SELECT DISTINCT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst
    FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM (SELECT string_split(host, '.') AS l FROM hosts) WHERE len(l) > 2)
),
links AS MATERIALIZED (
    SELECT src, dst, sum(weight) AS weight FROM (
        SELECT src, dst, 1 AS weight FROM family WHERE src <> '' AND dst <> '' AND src <> dst
        UNION ALL SELECT host, dst, 1 FROM (
            SELECT DISTINCT r, host, translate(unnest(regexp_extract_all(html, '{quoted(T.HREF)}', 1)), '{T.UPPER}', '{T.LOWER}') AS dst FROM cut)
        WHERE host <> '' AND host <> dst
    ) GROUP BY src, dst
),
shares AS MATERIALIZED (
    SELECT kind, host, next, CAST(weight AS DOUBLE) / CAST(sum(weight) OVER (PARTITION BY kind, host) AS DOUBLE) AS share FROM (
        SELECT 'trust' AS kind, src AS host, dst AS next, weight FROM links UNION ALL SELECT 'distrust', dst, src, weight FROM links)
),
spread AS (
    SELECT kind, host, got FROM (SELECT 'trust' AS kind, host, trust AS got FROM hosts UNION ALL SELECT 'distrust', host, distrust FROM hosts) WHERE got > 0
    UNION ALL
    SELECT kind, next, CAST(sum(handed) AS BIGINT) FROM (
        SELECT kind, next, floor(CAST({T.DAMPING} AS DOUBLE) * CAST(got AS DOUBLE) * share) AS handed FROM spread s JOIN shares USING (kind, host))
    GROUP BY kind, next HAVING sum(handed) > 0
),
scores AS (
    SELECT host, coalesce(sum(got) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(got) FILTER (kind = 'distrust'), 0) AS distrust
    FROM spread GROUP BY host
)
SELECT page_id, host, path, rule, CAST(coalesce(trust, 0) AS BIGINT) AS trust, CAST(coalesce(distrust, 0) AS BIGINT) AS distrust,
       coalesce(ruled, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) >= {T.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN scores USING (host)
"""


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({column} AS VARCHAR))) AS VARCHAR) || ':' || CAST({column} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of a decimal number, bit by bit
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"""

MANIFEST = f"""
WITH RECURSIVE docs AS MATERIALIZED (
    SELECT doc_id, source, {_leaf('text')} AS leaf,
           CASE WHEN {CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS held
    FROM documents
),
numbered AS MATERIALIZED (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS total
    FROM docs
),
-- nodes of all trees, level by level
nodes AS (
    SELECT tree, 0 AS level, place, total, leaf AS node FROM numbered
    UNION ALL
    SELECT tree, max(level) + 1, place // 3, (max(total) + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM nodes WHERE total > 1 GROUP BY tree, place // 3
),
kept AS MATERIALIZED (SELECT * FROM nodes),
subroots AS MATERIALIZED (SELECT tree, node AS subroot, count(*) OVER () AS total FROM kept WHERE total = 1),
tops AS (
    SELECT 0 AS level, tree AS place, total, subroot AS node FROM subroots
    UNION ALL
    SELECT max(level) + 1, place // 3, (max(total) + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM tops WHERE total > 1 GROUP BY place // 3
),
-- siblings of every node, in one order of levels: those of the groups' trees, then those above
high AS (SELECT tree, max(level) AS levels FROM kept GROUP BY tree),
steps AS MATERIALIZED (
    SELECT tree, level, place, string_agg(before, '' ORDER BY spot) AS before, string_agg(after, '' ORDER BY spot) AS after FROM (
        SELECT a.tree, a.level, a.place, b.place AS spot, CASE WHEN b.place < a.place THEN b.node ELSE '' END AS before,
               CASE WHEN b.place > a.place THEN b.node ELSE '' END AS after
        FROM kept a JOIN kept b ON a.tree = b.tree AND a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.total > 1
    ) GROUP BY tree, level, place
),
top_steps AS MATERIALIZED (
    SELECT level, place, string_agg(before, '' ORDER BY spot) AS before, string_agg(after, '' ORDER BY spot) AS after FROM (
        SELECT a.level, a.place, b.place AS spot, CASE WHEN b.place < a.place THEN b.node ELSE '' END AS before,
               CASE WHEN b.place > a.place THEN b.node ELSE '' END AS after
        FROM tops a JOIN tops b ON a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.total > 1
    ) GROUP BY level, place
),
walk AS (
    SELECT n.tree, n.place, doc_id, leaf, held AS node, '' AS proof, 0 AS level, CASE WHEN levels = 0 THEN n.tree ELSE place END AS spot, levels
    FROM numbered n JOIN high USING (tree)
    UNION ALL
    SELECT w.tree, w.place, doc_id, leaf, sha256(coalesce(s.before, t.before) || node || coalesce(s.after, t.after)),
           proof || coalesce(s.before, t.before) || coalesce(s.after, t.after), w.level + 1, CASE WHEN w.level + 1 = levels THEN w.tree ELSE spot // 3 END, levels
    FROM walk w LEFT JOIN steps s ON w.level < levels AND s.tree = w.tree AND s.level = w.level AND s.place = spot
    LEFT JOIN top_steps t ON w.level >= levels AND t.level = w.level - levels AND t.place = spot
    WHERE s.before IS NOT NULL OR t.before IS NOT NULL
),
ends AS (SELECT *, row_number() OVER (PARTITION BY tree, place ORDER BY level DESC) AS back FROM walk)
SELECT doc_id, leaf, subroot, (SELECT node FROM tops WHERE total = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root,
       node = (SELECT node FROM tops WHERE total = 1) AS verified
FROM ends JOIN subroots USING (tree) WHERE back = 1
"""
