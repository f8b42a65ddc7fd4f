"""Risk-controlled quality rules.

A rule rejects a document whose score exceeds a cutoff.  Cutoffs are not
guessed: a labelled holdout selects them per stratum, so that with probability
``1 - delta`` over the holdout *no* selected cutoff rejects more than its share
of ``alpha`` of the good documents of its stratum.

For each stratum, rule and grid cutoff, the holdout gives ``n`` good documents
of which the cutoff rejects ``k``.  The cutoff is admissible if the one-sided
exact (Clopper-Pearson) upper bound on the rejection rate is at most
``alpha / rules``; which is the same as ``P(Binomial(n, alpha / rules) <= k) <=
delta / tests``.  ``tests`` counts the strata times the rules (Bonferroni), so
the guarantee holds at once for all.  Within a rule, cutoffs form a fixed
sequence from lax to strict that stops at the first failure, which costs no
further correction; as ``k`` only grows along it, each cutoff may be tested for
itself.  Among the admissible
cutoffs the one is taken that catches most bad documents net of good ones (the
laxest of these on ties), and none where nothing is caught: a rule that does
not help never rejects.

Everything here is DataFrame functions.  The corpus is scanned once for the
scores; what is joined back is one row per stratum.

Edge cases: a null text is an empty text, without words, and fails the base
rules.  A null stratum is a stratum of its own.  A stratum without labels gets
no cutoffs and keeps what passes the base rules.  Rows may repeat.  A label
that is null, or whose document is missing, is ignored; a document labelled
both good and bad counts as good, as the guarantee concerns these.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, words, written

SYMBOLS = "#*$%&|<>"
#: Rules, each a score from 0 to 1 given the columns that ``features`` adds.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
#: Cutoffs tried, in thousandths.  They are fixed before any label is read.
GRID = (5, 10, 20, 30, 50, 80, 120, 160, 200, 250, 300, 400, 500, 650, 800)
#: Strata above this number are joined by a shuffle in place of a broadcast.
MOST_BROADCAST = 20_000


@dataclass(frozen=True)
class Risk:
    """``alpha``: the rate of good documents that may be rejected in a stratum.
    ``delta``: the probability that the guarantee fails anywhere."""

    alpha: float = 0.05
    delta: float = 0.05


def _adjacent_repeats(keys: Column) -> Column:
    """How many words lie in windows whose key occurs twice or more.

    Sorting (key, position) puts equal windows side by side, so the cost is
    that of a sort, however often a window repeats.
    """
    pairs = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def positions(s: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            return x["k"].eqNullSafe(F.get(s, i - 1)["k"]) | x["k"].eqNullSafe(F.get(s, i + 1)["k"])

        hits = F.array_sort(F.transform(F.filter(s, repeated), lambda x: x["i"]))
        # A window at i covers words i to i + 2; of these, the next repeated
        # window at j covers all from j on.
        return F.transform(
            F.array(hits),
            lambda h: F.aggregate(
                F.transform(h, lambda i, at: F.least(F.lit(3), F.coalesce(F.get(h, at + 1) - i, F.lit(3)))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )[0]

    return F.transform(F.array(pairs), positions)[0]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines and n_capitals.

    Columns of these names that ``docs`` has are replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = F.col("__words")
    windows = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )
    k = F.col("__keys")
    n = F.size("__words").cast("long")
    out = (
        docs.withColumn("__words", words(F.col(text)))
        .withColumn("__lines", lines)
        .withColumn("__keys", windows)
        .withColumns(
            {
                "n_words": n,
                "word_chars": F.length(F.regexp_replace(whole, SPACE + "+", "")).cast("long"),
                "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
                "n_lines": F.size("__lines").cast("long"),
                "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
                "n_capitals": (F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
                "n_repeat_words": F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(_adjacent_repeats(k)).cast("long"),
            }
        )
    )
    return out.drop("__words", "__lines", "__keys")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def exceeds(rule: str, cutoff: Column | int) -> Column:
    """Whether a rule's score is over a cutoff in thousandths, in integers."""
    top, bottom = RULES[rule]
    return 1000 * F.col(top) > cutoff * F.greatest(F.col(bottom), F.lit(1))


def log_factorial(n: Column) -> Column:
    """ln n!: exact sums below 16, Stirling's series with four terms above.
    The series errs by less than 1e-13 there."""
    x = F.greatest(n, F.lit(16)).cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(16)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    return F.when(n <= 16, small).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k).

    Terms fall off below the mode; from k or the mode downwards, those beyond
    40 deviations are under 1e-300 of the sum, so the work is the root of n.
    """
    deviations = (40 * F.sqrt(n * p * (1 - p)) + 60).cast("long")
    top = F.least(k, (F.floor((n + 1) * p) + deviations).cast("long"))
    low = F.greatest(F.lit(0).cast("long"), F.least(top, F.floor((n + 1) * p).cast("long")) - deviations)

    def log_term(i: Column) -> Column:
        return log_factorial(n) - log_factorial(i) - log_factorial(n - i) + i * F.log(F.lit(p)) + (n - i) * F.log1p(F.lit(-p))

    start = F.struct(log_term(top).alias("at"), F.lit(0.0).alias("rest"), F.lit(0.0).alias("log_ratio"))

    def add(acc: Column, j: Column) -> Column:
        # From term i + 1 to term i: times (i + 1) / (n - i) * (1 - p) / p.
        i = top - j
        ratio = acc["log_ratio"] + F.log((i + 1) / (n - i).cast("double")) + F.log(F.lit((1 - p) / p))
        return F.struct(acc["at"].alias("at"), (acc["rest"] + F.exp(F.least(ratio, F.lit(700.0)))).alias("rest"), ratio.alias("log_ratio"))

    steps = F.when(top > low, F.sequence(F.lit(1).cast("long"), F.greatest(top - low, F.lit(1).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, start, add)
    return F.least(F.lit(1.0), F.exp(F.least(F.lit(0.0), total["at"] + F.log1p(total["rest"]))))


def select_cutoffs(scored: DataFrame, labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id", stratum: str = "lang", good: str = "quality") -> DataFrame:
    """One row per stratum of the holdout: ``stratum`` and ``cutoffs``, a map
    from rule to cutoff in thousandths.

    ``scored`` has ``features`` columns of every document; only those that the
    base rules keep take part, as the rules judge only these."""
    labelled = (
        labels.where(F.col(good).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("__id"))
        .agg(F.max(F.col(good).cast("int")).alias("__good"))
    )
    rows = scored.where(~base_failed()).select(F.col(id_col).cast("long").alias("__id"), F.col(stratum).cast("string").alias("stratum"), *{c for r in RULES.values() for c in r})
    # Counts by stratum: at most strata x rules x cutoffs rows leave a task.
    sums = {f"{r}_{c}_{g}": F.sum((exceeds(r, c) & (F.col("__good") == g)).cast("long")) for r in RULES for c in GRID for g in (0, 1)}
    counts = (
        rows.join(labelled, "__id")
        .groupBy("stratum")
        .agg(F.sum("__good").cast("long").alias("n_good"), *[v.alias(k) for k, v in sums.items()])
    )
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{c}_1").alias("k"), F.col(f"{r}_{c}_0").alias("caught")) for r in RULES for c in GRID])
    counts = written(counts, "counts")
    tests = max(1, counts.count()) * len(RULES)
    flat = counts.select("stratum", "n_good", F.explode(cells).alias("c")).select("stratum", "n_good", "c.*")
    admissible = flat.where((F.col("caught") > F.col("k")) & (F.col("n_good") > 0)).where(
        binomial_tail(F.col("n_good"), F.col("k"), risk.alpha / len(RULES)) <= F.lit(risk.delta / tests)
    )
    best = admissible.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(F.col("caught") - F.col("k"), F.col("cutoff"))).alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "cutoff")))).alias("cutoffs"))


def rejected(cutoffs: Column) -> Column:
    """Whether any rule of the map rejects; a rule that it lacks does not."""
    hits = [F.coalesce(exceeds(r, F.element_at(cutoffs, r)), F.lit(False)) for r in RULES]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def judge(scored: DataFrame, labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id", stratum: str = "lang", good: str = "quality") -> DataFrame:
    """``scored`` with ``base_failed`` and ``kept``."""
    cutoffs = written(select_cutoffs(scored, labels, risk, id_col, stratum, good), "cutoffs").withColumnRenamed("stratum", "__stratum").withColumnRenamed("cutoffs", "__cutoffs")
    if cutoffs.count() <= MOST_BROADCAST:
        cutoffs = F.broadcast(cutoffs)
    return (
        scored.join(cutoffs, F.col(stratum).cast("string").eqNullSafe(F.col("__stratum")), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~rejected(F.col("__cutoffs")))
        .drop("__stratum", "__cutoffs")
    )


def quality_rules(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id", text: str = "text", stratum: str = "lang", good: str = "quality", carry: bool = False) -> DataFrame:
    """Every document's features, ``base_failed`` and ``kept``.

    ``carry`` keeps the other columns of ``docs``; otherwise only ids, stratum
    and features are written between the two passes."""
    names = [id_col, stratum]
    scored = features(docs if carry else docs.select(id_col, stratum, text), text)
    if not carry:
        scored = scored.select(*dict.fromkeys(names), *dict.fromkeys(c for r in RULES.values() for c in r))
    return judge(written(scored, "scored"), labels, risk, id_col, stratum, good)
