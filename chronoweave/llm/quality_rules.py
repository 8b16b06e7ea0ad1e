"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how far each can be
trusted, and the posterior probability of good text decides.

Only DataFrame functions touch the rows. The rows reach the driver as counts of vote patterns, at most 3 to the power
of the number of rules, whatever the input's size; the EM steps are sums over that table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, Scratch, words

#: Each rule: bad if, good if; neither: it abstains. Every rule votes both ways, and each kind of fault is seen by more
#: than one of them: rules that agree are what EM learns from (a fault that a single rule sees is indistinguishable from a
#: rule that errs). "brief" is a weak rule, and is found to be one. Fractions are compared as integer products so that
#: every engine gives the same vote. Texts under 20 words give a rule on shares too little to go by, so it abstains there.
#: A text's different words grow about with the root of its length, so "variety" compares their square with the length.
RULES = {
    "symbols": ("10 * n_symbols > 3 * n_words", "20 * n_symbols <= n_words"),
    "marked": ("n_words >= 20 AND 4 * n_marked > n_words", "n_words >= 20 AND 20 * n_marked <= n_words"),
    "letters": ("n_words >= 20 AND 5 * n_letters < 4 * word_chars", "n_words >= 20 AND 100 * n_letters >= 92 * word_chars"),
    "repeats": ("n_words >= 20 AND 2 * n_repeat_words > n_words", "n_words >= 20 AND 5 * n_repeat_words <= n_words"),
    "variety": ("n_words >= 20 AND n_distinct * n_distinct < 4 * n_words", "n_words >= 20 AND n_distinct * n_distinct >= 16 * n_words"),
    "lines": ("n_lines >= 4 AND 2 * n_dup_lines > n_lines", "n_lines >= 4 AND 4 * n_dup_lines <= n_lines"),
    "shouting": ("n_words >= 20 AND 10 * n_upper > 6 * word_chars", "n_words >= 20 AND 5 * n_upper <= word_chars"),
    "exclaims": ("n_words >= 10 AND 2 * n_exclaims > n_words", "n_words >= 10 AND 10 * n_exclaims <= n_words"),
    "word_length": ("word_chars < 2 * n_words OR word_chars > 15 * n_words", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    "brief": ("n_words < 80", "n_words >= 120"),
}
#: Steps of EM, and pseudo-counts of each vote in either class and of the prior.
STEPS, SMOOTH = 12, 1.0
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_exclaims", "n_letters", "n_marked")


def _repeat_words(tokens: str) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are sorted with their positions, equal neighbours
    repeat. Texts whose windows are all distinct, most of them, are settled by a hash set and never sorted."""
    return F.expr(
        f"""CASE WHEN size({tokens}) < 4 OR size(array_distinct(windows)) = size(windows) THEN 0L ELSE
        CAST(transform(array(sort_array(transform(windows, (w, i) -> struct(w AS w, i AS i)))), s ->
          size(array_distinct(flatten(transform(
            filter(s, (x, i) -> coalesce(get(s, i - 1).w = x.w, false) OR coalesce(get(s, i + 1).w = x.w, false)),
            x -> array(x.i, x.i + 1, x.i + 2))))))[0] AS LONG) END"""
    )


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of SIGNALS (long), which replace columns of these names; all others stay, whatever their
    names. A null text counts as an empty one."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = {c: f"_{i}" for i, c in enumerate(docs.columns) if c not in SIGNALS}  # names apart from those of the steps
    blank = lambda c: F.btrim(c, F.lit(BLANKS)) == ""
    first = docs.select(*[F.col(c).alias(k) for c, k in kept.items()], words(F.col(text)).alias("tokens"), F.filter(F.split(t, "\n"), lambda x: ~blank(x)).alias("lines"), t.alias("whole"))
    second = first.withColumn(
        "windows",
        F.expr("CASE WHEN size(tokens) < 4 THEN CAST(array() AS array<string>) ELSE transform(sequence(0, size(tokens) - 3), i -> concat_ws(' ', tokens[i], tokens[i + 1], tokens[i + 2])) END"),
    )
    symbols = F.length(F.regexp_replace("whole", "[^#*$%&|<>]+", ""))  # replace and regexp_replace are far faster than translate
    return second.select(
        *[F.col(k).alias(c) for c, k in kept.items()],
        F.size("tokens").cast("long").alias("n_words"),
        F.length(F.regexp_replace("whole", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words("tokens").alias("n_repeat_words"),
        F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("whole", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        (F.length("whole") - F.length(F.replace(F.col("whole"), F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
        F.length(F.regexp_replace("whole", r"[^\p{L}\p{N}]+", "")).cast("long").alias("n_letters"),
        F.when(symbols == 0, 0).otherwise(F.size(F.filter("tokens", lambda w: w.rlike("[#*$%&|<>]")))).cast("long").alias("n_marked"),
    )


def votes(name: str) -> Column:
    bad, good = RULES[name]
    return F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END").alias(f"v_{name}")


def fit(patterns: list[tuple[tuple[int, ...], int]], steps: int = STEPS) -> tuple[float, list[dict[int, float]]]:
    """EM over counted vote patterns: log odds of the prior, and of each rule's votes, for good against bad.

    Each rule has, in either class, a probability of voting good where it votes; where it abstains it says nothing. The
    start takes a pattern for bad (0.1) where two rules or more concur in that and for good (0.9) otherwise, which also
    names the classes: no rule's word is taken alone. From there on a rule's votes weigh what its agreement with the
    others earns it, so a rule that stands alone as often as not is outvoted where it does, and weak ones add up.
    """
    if not patterns:
        return 0.0, []
    m, total = len(patterns[0][0]), sum(n for _, n in patterns)
    q = [0.1 if v.count(-1) > 1 else 0.9 for v, _ in patterns]
    prior, odds = 0.0, []
    for _ in range(steps):
        good = sum(n * x for (_, n), x in zip(patterns, q, strict=True))
        prior = math.log((good + SMOOTH) / (total - good + SMOOTH))
        odds = []
        for j in range(m):
            row = {0: 0.0}
            held = [(v[j], n * x, n * (1 - x)) for (v, n), x in zip(patterns, q, strict=True) if v[j]]
            for vote in (-1, 1):
                a, b = (sum(h[k] for h in held if h[0] == vote) for k in (1, 2))
                row[vote] = math.log((a + SMOOTH) / (sum(h[1] for h in held) + 2 * SMOOTH)) - math.log((b + SMOOTH) / (sum(h[2] for h in held) + 2 * SMOOTH))
            odds.append(row)
        q = [1 / (1 + math.exp(-max(-500.0, min(500.0, prior + sum(o[x] for o, x in zip(odds, v, strict=True)))))) for v, _ in patterns]
    return prior, odds


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """docs' signals with votes v_<rule>, quality_prob (posterior probability of good text), base_failed and kept.

    The text column itself is not returned. Null and empty texts have no words and fail the base; repeated rows each
    get their verdict; an empty table gives an empty result. Columns named as a signal, vote or verdict are replaced.
    """
    docs = docs.drop("quality_prob", "base_failed", "kept", *[f"v_{r}" for r in RULES])
    scratch = scratch or Scratch(docs.sparkSession, "rules")
    got = signals(docs, text).drop(text)
    voted = scratch.table(got.select("*", *[votes(r) for r in RULES]), "votes")
    return verdicts(voted, threshold)


def verdicts(voted: DataFrame, threshold: float = 0.5) -> DataFrame:
    cols = [f"v_{r}" for r in RULES]
    counted = voted.groupBy(*cols).count().collect()  # at most 3 ** len(RULES) rows
    prior, odds = fit(sorted((tuple(r[c] for c in cols), r["count"]) for r in counted))
    logit = F.lit(prior)
    for c, row in zip(cols, odds, strict=False):
        logit = logit + F.when(F.col(c) == 1, F.lit(row[1])).when(F.col(c) == -1, F.lit(row[-1])).otherwise(F.lit(row[0]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("quality_prob", 1 / (1 + F.exp(-logit))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_prob") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text passes, with docs' own columns. Votes are written beside the rows, so that the
    text is tokenised once and no join by id is needed."""
    scratch = Scratch(docs.sparkSession, "rules")
    numbered = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    got = signals(numbered, "text").drop("text")
    voted = scratch.table(got.select("*", *[votes(r) for r in RULES]), "voted")
    return verdicts(voted, threshold).where("kept").select("row.*")
