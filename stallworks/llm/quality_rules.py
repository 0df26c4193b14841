"""Quality rules as weak supervision.

Every rule votes good (1), bad (0) or abstains (null) on a document.  Votes are
counted per pattern over the whole corpus, expectation-maximisation estimates
how often each rule votes bad on good and on bad documents, and the posterior
probability of being good takes the place of "all rules must pass".

Native throughout: text measures stay inside the document's row, and the EM
runs on the table of vote patterns (at most 3 to the number of rules).

Defined cases: a null or empty text has no words and fails the base rule;
repeated rows are documents of their own; a posterior of exactly the threshold is kept; very long texts are measured whole, inside their
row; further columns of any name are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallworks.llm.tables import Scratch

# Characters that split words, symbols, and rules as (name, good, bad, rate of bad votes on bad documents,
# rate on good ones) over the measures below; the rates are the prior beliefs of the EM.
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
SPECIAL = "[^#*$%&|<>!?.A-Z]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
RULES = [
    ("length", "n_words >= 80", "n_words < 20", 0.05, 0.02),
    ("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words",
     0.1, 0.002),
    ("symbols", "20 * n_symbols <= n_words", "5 * n_symbols > n_words", 0.25, 0.002),
    ("symbol_flood", "10 * n_symbols <= n_words", "10 * n_symbols > 4 * n_words", 0.25, 0.002),
    ("dup_lines", "10 * n_dup_lines <= n_lines", "n_lines >= 6 and 2 * n_dup_lines > n_lines", 0.1, 0.01),
    ("repeats", "10 * n_repeat_words <= n_words", "n_words >= 150 and 10 * n_repeat_words > 3 * n_words", 0.25, 0.005),
    ("shouting", "10 * n_upper <= word_chars", "10 * n_upper > 4 * word_chars", 0.25, 0.002),
    ("marks", "10 * n_marks <= n_words", "10 * n_marks > 3 * n_words", 0.25, 0.002),
    ("sentences", "n_stops > 0 and n_stops between n_words / 60 and n_words / 3", "n_stops = 0 and n_words >= 200", 0.1, 0.01),
]
#: prior share of bad documents, and weight of all prior beliefs as a multiple of the corpus
PRIOR_BAD, PRIOR_WEIGHT = 0.15, 0.5
#: rounds end when no rate moves by more; that many rounds are far beyond what it takes
TOLERANCE, MAX_ROUNDS = 1e-4, 500


def _count(text: Column, characters: str) -> Column:
    """How many of these characters a short text has."""
    left = text
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(left)).cast("long")


def measures(text: Column) -> list[list[Column]]:
    """Projections, one after another, that measure a text: the last holds the numbers.

    Windows of three words are told apart by a 64-bit hash within their document.
    """
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, SPACES), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda w: F.regexp_like(w, F.lit("[^\\x20\\x09-\\x0D]")))
    hashes = F.expr("""case when size(words) >= 3 then
        transform(slice(words, 1, size(words) - 2), (w, i) -> xxhash64(w, words[i + 1], words[i + 2]))
        else cast(array() as array<bigint>) end""")
    # equal windows stand side by side once sorted; texts without an equal pair are not sorted
    ordered = F.expr("""case when size(array_distinct(hashes)) < size(hashes)
        then sort_array(transform(hashes, (h, i) -> struct(h, i))) end""")
    starts = F.expr("""sort_array(transform(filter(ordered, (x, k) ->
        coalesce(x.h = get(ordered, k - 1).h, false) or coalesce(x.h = get(ordered, k + 1).h, false)), x -> x.i))""")
    repeated = F.expr("""coalesce(aggregate(transform(starts, (s, k) -> least(3, coalesce(get(starts, k + 1), s + 3) - s)),
        0, (a, b) -> a + b), 0)""")
    numbers = [F.col(c) for c in NUMBERS if c != "n_repeat_words"]
    return [
        [words.alias("words"), lines.alias("lines"), F.regexp_replace(t, SPECIAL, "").alias("special")],
        [hashes.alias("hashes"), F.size("words").cast("long").alias("n_words"),
         F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
         _count(F.col("special"), SYMBOLS).alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
         (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
         F.length(F.regexp_replace("special", "[^A-Z]+", "")).cast("long").alias("n_upper"),
         _count(F.col("special"), "!?").alias("n_marks"), _count(F.col("special"), ".!?").alias("n_stops")],
        [*numbers, ordered.alias("ordered")],
        [*numbers, starts.alias("starts")],
        [*numbers, repeated.cast("long").alias("n_repeat_words")],
    ]


NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_stops"]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def votes(rules: list[tuple]) -> Column:
    """One character per rule: g, b or - (abstain)."""
    return F.concat(*(F.expr(f"case when {bad} then 'b' when {good} then 'g' else '-' end") for _, good, bad, *_ in rules))


def posterior(pattern: Column, prior: float, on_bad: list[float], on_good: list[float]) -> Column:
    """Probability of being good, from the votes that were given.

    The rates stand in array literals: every round then runs the same compiled code.
    """
    rates = F.array(*(F.lit(float(x)) for x in [prior, *on_bad, *on_good]))
    bad, good = F.get(rates, F.lit(0)), F.lit(1.0) - F.get(rates, F.lit(0))
    for k in range(len(on_bad)):
        vote = F.substring(pattern, k + 1, 1)
        p, q = F.get(rates, F.lit(1 + k)), F.get(rates, F.lit(1 + len(on_bad) + k))
        bad = bad * F.when(vote == "b", p).when(vote == "g", 1.0 - p).otherwise(F.lit(1.0))
        good = good * F.when(vote == "b", q).when(vote == "g", 1.0 - q).otherwise(F.lit(1.0))
    return good / (good + bad)


def estimate(patterns: DataFrame, rules: list[tuple], tolerance: float = TOLERANCE) -> tuple[float, list[float], list[float]]:
    """EM over (pattern, n) until it stands still: share of bad documents, and each rule's bad-vote rate on bad and on good ones."""
    first_bad, first_good = [r[3] for r in rules], [r[4] for r in rules]
    prior, on_bad, on_good = PRIOR_BAD, first_bad, first_good
    for _ in range(MAX_ROUNDS):
        scored = patterns.withColumn("good", posterior(F.col("pattern"), prior, on_bad, on_good) * F.col("n"))
        votes_given = F.posexplode(F.split("pattern", "")).alias("rule", "vote")
        scored = scored.select("n", "good", (F.col("n") - F.col("good")).alias("bad"), votes_given)
        by_rule = {r["rule"]: r for r in scored.groupBy("rule").agg(
            F.sum("n").alias("n"), F.sum("bad").alias("bad"),
            *(F.sum(F.when(test, F.col(side)).otherwise(F.lit(0.0))).alias(f"{name}_{side}")
              for side in ("bad", "good") for name, test in (("b", F.col("vote") == "b"), ("v", F.col("vote") != "-"))),
        ).collect()}
        if not by_rule:
            return prior, on_bad, on_good
        last = [prior, *on_bad, *on_good]
        n, bad = by_rule[0]["n"], by_rule[0]["bad"]
        prior = (bad + PRIOR_WEIGHT * n * PRIOR_BAD) / (n + PRIOR_WEIGHT * n)
        on_bad, on_good = (
            [(by_rule[k][f"b_{side}"] + weight * first[k]) / (by_rule[k][f"v_{side}"] + weight) for k in range(len(rules))]
            for side, first, weight in (("bad", first_bad, PRIOR_WEIGHT * n * PRIOR_BAD),
                                        ("good", first_good, PRIOR_WEIGHT * n * (1.0 - PRIOR_BAD))))
        if max(abs(a - b) for a, b in zip(last, [prior, *on_bad, *on_good])) < tolerance:
            return prior, on_bad, on_good
    raise RuntimeError(f"rates of the rules still move after {MAX_ROUNDS} rounds")


def judged(
    docs: DataFrame, text: str, carry: dict[str, Column], rules: list[tuple] = RULES, threshold: float = 0.5,
    scratch: Scratch | None = None,
) -> DataFrame:
    """The carried columns, the measures, ``votes``, ``base_failed``, ``p_good`` and ``kept`` of every row."""
    scratch = scratch or Scratch(docs.sparkSession)
    names = [f"carried_{c}" for c in carry]
    df = docs.select(*(c.alias(n) for c, n in zip(carry.values(), names)), F.col(text).alias("text"))
    for columns in measures(F.col("text")):
        df = df.select(*(F.col(n) for n in names), *columns)
    df = scratch.write(df.withColumn("votes", votes(rules)))
    patterns = scratch.write(df.groupBy(F.col("votes").alias("pattern")).agg(F.count(F.lit(1)).alias("n")))
    prior, on_bad, on_good = estimate(patterns, rules)
    scored = df.withColumn("base_failed", base_failed()).withColumn("p_good", posterior(F.col("votes"), prior, on_bad, on_good))
    scored = scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    return scored.withColumnsRenamed(dict(zip(names, carry)))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good, votes."""
    return judged(docs, text, {"doc_id": F.col(doc_id)}, threshold=threshold).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("p_good", 6).alias("p_good"), "votes",
    )
