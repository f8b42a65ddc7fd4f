"""Secret scans: fixed patterns, and character Markov models for the rest.

Patterns find assignments, access keys and long hexadecimal runs.  They miss
secrets that stand alone.  For these, first-order Markov models over characters
are trained from labelled samples: some of random strings, one for each kind of
alphabet, and some of ordinary identifiers, one for each kind of shape.  What
patterns' spans leave of a maximal run of token characters, in pieces of
``SHORTEST`` or more, becomes further spans (kind ``markov``) where the
log-likelihood ratio of the best random model to the best ordinary one, summed
over the whole piece, is over a threshold: longer pieces give more evidence.

The threshold is taken from samples that trained no model: every fifth by hash
of the trained generators, and all of the generators that are held out whole.
At most the share ``false`` of ordinary ones of any held-out kind scores above
it, and it is never under ``least``, the log of the odds against a secret.

All of it is DataFrame functions: matches come from ``regexp_extract_all`` and
their places from the lengths of what ``split`` leaves between them, and the
models' tables of transitions (bounded by the alphabet's square) are literals.
Texts are scanned whole, in one pass without a shuffle.

Edge cases: a null or empty text has no spans.  Rows may repeat.  Training
samples that are null or have under two characters are ignored; with no samples
of either class nothing is added.  An empty table gives no rows, and a model of
the made samples alone.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import written

#: Kind, pattern, in the order in which ties are listed.
PATTERNS = {
    "assign": r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
}
SHORTEST = 12
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: A character's state is its code less this; 0 is for all that are none.
BASE = ord("+") - 1
STATES = ord("z") - BASE + 1
SPAN = "array<struct<s:int,k:int,e:int,kind:string>>"


@dataclass(frozen=True)
class Markov:
    """``random`` and ``ordinary``: for each model, log P(b | a) in units of
    1 / ``UNIT`` by a * STATES + b; state 0 is before the first character."""

    random: tuple[tuple[int, ...], ...]
    ordinary: tuple[tuple[int, ...], ...]
    threshold: float


UNIT = 256


def _steps(token: Column) -> Column:
    """The transitions of a token, from its start on, as indexes into a table."""
    code = lambda c: F.ascii(c) - BASE
    codes = F.transform(F.split(token, ""), lambda c: F.when(code(c).between(1, STATES - 1), code(c)).otherwise(0))
    return F.transform(F.array(codes), lambda a: F.transform(a, lambda x, i: F.when(i > 0, F.get(a, i - 1) * STATES).otherwise(0) + x))[0]


def _total(steps: Column, table: tuple[int, ...]) -> Column:
    held = F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<int>")
    return F.aggregate(steps, F.lit(0), lambda acc, i: acc + F.get(held, i))


def _best(steps: Column, tables: tuple[tuple[int, ...], ...]) -> Column:
    sums = [_total(steps, t) for t in tables]
    return F.greatest(*sums) if len(sums) > 1 else sums[0]


def ratio(token: Column, model: Markov) -> Column:
    """The log-likelihood ratio of a whole token."""
    if not model.random or not model.ordinary:
        return F.lit(0.0)
    both = F.transform(F.array(_steps(token)), lambda steps: _best(steps, model.random) - _best(steps, model.ordinary))
    return both[0] / F.lit(float(UNIT))


def is_random(token: Column, model: Markov) -> Column:
    """Whether a token's ratio is over the threshold.

    No random model gives a transition more than the largest of its entries, so
    the first ordinary model alone clears nearly all words; only the rest meet
    all models."""
    if not model.random or not model.ordinary:
        return F.lit(False)
    most, least = max(max(t) for t in model.random), math.floor(model.threshold * UNIT)

    def judged(steps: Column) -> Column:
        cleared = F.size(steps) * most - _total(steps, model.ordinary[0]) <= least
        return F.when(cleared, False).otherwise(_best(steps, model.random) - _best(steps, model.ordinary) > model.threshold * UNIT)

    return F.transform(F.array(_steps(token)), judged)[0]


def train(samples: DataFrame, false: float = 0.0002, least: float = 15.0, smooth: float = 4.0, shortest: int = SHORTEST) -> Markov:
    """Models from ``samples`` (token string, random boolean, kind string, held
    boolean): one for each kind of either class.  Kinds that are held out, and
    of the others every fifth distinct sample by hash, set the threshold."""
    usable = (F.length("token") >= 2) & F.col("random").isNotNull()
    tokens = written(samples.where(usable).select("token", "random", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("held", F.lit(False)).alias("held")).distinct(), "samples")
    held = F.col("held") | (F.pmod(F.xxhash64("token"), F.lit(5)) == 0)
    counts = tokens.where(~held).select("random", "kind", F.explode(_steps(F.col("token"))).alias("step")).groupBy("random", "kind", "step").count()
    # At most STATES x STATES rows for each kind.
    n: dict[tuple[bool, str], dict[int, int]] = {}
    for r in counts.collect():
        n.setdefault((r.random, r.kind), {})[r.step] = r["count"]
    # The model of most transitions comes first, as it clears most.
    kinds = sorted(n, key=lambda k: (-sum(n[k].values()), k))
    tables = {c: tuple(_log_transitions(n[k], smooth) for k in kinds if k[0] is c) for c in (True, False)}
    model = Markov(tables[True], tables[False], least)
    scored = tokens.where(held & ~F.col("random") & (F.length("token") >= shortest)).withColumn("r", ratio(F.col("token"), model))
    worst = scored.groupBy("kind").agg(F.percentile("r", F.lit(1 - false)).alias("r")).agg(F.max("r")).first()[0]
    return Markov(model.random, model.ordinary, max(least, worst or 0.0))


def _log_transitions(n: dict[int, int], smooth: float) -> tuple[int, ...]:
    """log P(b | a) by a * STATES + b.

    Each row is smoothed towards how often characters occur at all, so that a
    character which is rare in a kind is unlikely also after one that the kind
    never shows."""
    after = [0.5] * STATES
    rows = [0] * STATES
    for step, x in n.items():
        after[step % STATES] += x
        rows[step // STATES] += x
    whole = sum(after)
    return tuple(round(UNIT * math.log((n.get(a * STATES + b, 0) + smooth * after[b] / whole) / (rows[a] + smooth))) for a in range(STATES) for b in range(STATES))


LOWER, UPPER, DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]

#: Random strings by kind: what is left out of base-64 characters, and whether
#: the generator trains no model.
RANDOM = {
    "any": ("", False),
    "lower and digits": (UPPER + "+/", False),
    "upper and digits": (LOWER + "+/", False),
    "lower": (UPPER + DIGITS + "+/", False),
    "upper": (LOWER + DIGITS + "+/", False),
    "letters": (DIGITS + "+/", True),
    "letters and digits": ("+/", True),
    "no look-alikes": ("0OIl+/", True),
    "base 32": (LOWER + "0189+/", True),
}


def random_samples(spark: SparkSession, n: int = 2000) -> DataFrame:
    """Labelled random strings over several alphabets, ``n`` of each, made from
    digests of running numbers; and hexadecimal ones."""
    name = F.concat(F.lit("sample "), F.col("id").cast("string"))
    digest = F.sha2(name, 512)
    wide = F.translate(F.base64(F.unhex(digest)), "=\r\n", "")
    cut = F.pmod(F.col("id"), F.lit(29)) + SHORTEST
    made = [F.struct(F.translate(wide, drop, "").alias("t"), F.lit(kind).alias("kind"), F.lit(held).alias("held")) for kind, (drop, held) in RANDOM.items()]
    made += [F.struct(F.translate(wide, "+/", "-_").alias("t"), F.lit("url-safe").alias("kind"), F.lit(True).alias("held")), F.struct(digest.alias("t"), F.lit("hex").alias("kind"), F.lit(False).alias("held"))]
    rows = spark.range(n).select(F.explode(F.array(*made)).alias("m"), cut.cast("int").alias("n"))
    return rows.select(F.expr("substring(m.t, 1, n)").alias("token"), F.lit(True).alias("random"), "m.kind", "m.held")


def shape_samples(spark: SparkSession, n: int = 1500) -> DataFrame:
    """Labelled ordinary identifiers that are no words: dates, times, telephone
    and running numbers, UUIDs, versions, rules of one character."""
    h = lambda k: F.xxhash64(F.lit(k), "id")
    number = lambda k, most: F.pmod(h(k), F.lit(most)).cast("string")
    digits = lambda k, width: F.lpad(F.pmod(h(k), F.lit(10**width)).cast("string"), width, "0")
    within = lambda k, low, high: F.lpad((F.pmod(h(k), F.lit(high - low + 1)) + low).cast("string"), 2, "0")
    year, month, day = (F.pmod(h(1), F.lit(140)) + 1900).cast("string"), within(2, 1, 12), within(3, 1, 31)
    clock = [within(4, 0, 23), within(5, 0, 59), within(6, 0, 59)]
    raw = F.lower(F.hex(F.unhex(F.md5(F.col("id").cast("string")))))
    uuid = F.concat_ws("-", *[F.substring(raw, a, w) for a, w in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    some = lambda *choices: F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(h(9), F.lit(len(choices))) + 1).cast("int"))
    letter = lambda k, i: F.substring(F.lit(LOWER), (F.pmod(F.xxhash64(F.lit(k), "id", i), F.lit(26)) + 1).cast("int"), F.lit(1))
    part = lambda i: F.substring(F.concat(*[letter(k, i) for k in (1, 2, 3)]), F.lit(1), ((F.col("id") + i) % 5 % 3 + 1).cast("int"))
    made = {
        "numbers": [
            F.concat_ws("-", year, month, day),
            F.concat(F.concat_ws("-", year, month, day), F.lit("T"), F.concat_ws("-", *clock), F.lit("Z")),
            F.concat(year, month, day, F.lit("T"), *clock, F.lit("Z")),
            F.concat(F.lit("+"), number(1, 99), F.lit("-"), digits(2, 3), F.lit("-"), digits(3, 3), F.lit("-"), digits(4, 4)),
            F.concat(digits(2, 3), F.lit("-"), digits(3, 3), F.lit("-"), digits(4, 4)),
            F.concat(digits(5, 9), digits(6, 7)),
            F.concat_ws("/", number(1, 999), number(2, 999), number(3, 999), number(4, 9999)),
            F.concat(some("v", "V", "rev", "build"), F.concat_ws("-", number(1, 30), number(2, 30), number(3, 99))),
            F.concat(some("IMG", "DSC", "order", "invoice", "ID", "case"), some("_", "-"), year, month, day, some("_", "-"), digits(7, 6)),
        ],
        "uuid": [uuid, F.upper(uuid)],
        "short parts": [F.array_join(F.transform(F.sequence(F.lit(1), (F.pmod(h(7), F.lit(9)) + 5).cast("int")), part), sep) for sep in ("/", "-", "_")],
        "rules": [F.repeat(some("-", "=", "_", "/", "+"), 12 + (F.pmod(h(8), F.lit(60))).cast("int")), F.repeat(some("-=", "=-", "+-", "_/", "/-"), 8)],
    }
    held = {
        "dates in words": [F.concat(F.lit("log-"), F.concat_ws("-", year, month, day), F.lit("-"), F.concat_ws("-", *clock)), F.concat(year, F.lit("/"), month, F.lit("/"), day, F.lit("/"), digits(4, 4))],
        "numbers by fours": [F.concat_ws("-", *[digits(k, 4) for k in (1, 2, 3, 4)]), F.concat(F.lit("ISBN-978-"), digits(1, 1), F.lit("-"), digits(2, 4), F.lit("-"), digits(3, 4), F.lit("-"), digits(4, 1))],
        "uuid in words": [F.concat(some("id-", "urn/", "uuid="), uuid)],
    }
    rows = [F.struct(t.alias("token"), F.lit(kind).alias("kind"), F.lit(kind in held).alias("held")) for kind, shapes in (made | held).items() for t in shapes]
    return spark.range(n).select(F.explode(F.array(*rows)).alias("m")).select("m.token", F.lit(False).alias("random"), "m.kind", "m.held")


def ordinary_samples(docs: DataFrame, most: int = 500, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Labelled ordinary identifiers of words: those of the ``most`` distinct
    documents whose ids and texts hash lowest (the bound on this sample), and
    joined ones: snake, camel and kebab case, paths, capitals, with numbers.

    Words with a digit are left out, as some of them are secrets."""
    h = F.xxhash64(F.col(id_col), F.col(text))
    # Only hashes are ranked; then the texts at or under the last one, once each.
    last = docs.where(F.col(text).isNotNull()).select(h.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    low = docs.where(F.col(text).isNotNull() & (h <= F.lit(last).cast("long"))).select(h.alias("h"), F.col(text).alias("t"))
    few = low.groupBy("h").agg(F.min("t").alias("t"))
    words = F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,40}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    w = few.select(words.alias("w"))

    def joined(x: Column, i: Column) -> Column:
        y, z = F.get("w", i + 1), F.get("w", i + 2)
        number = F.pmod(F.xxhash64(x, i), F.lit(10000)).cast("string")
        shapes = [
            ("words", F.concat_ws("_", x, y, z)),
            ("words", F.concat(F.lower(x), F.initcap(y), F.initcap(z))),
            ("words", F.concat_ws("-", F.lower(x), F.lower(y), F.lower(z))),
            ("words", F.concat_ws("/", x, y, z)),
            ("words", F.concat(F.lit("/"), F.substring(x, 1, 1), F.lit("/"), y, F.lit("/"), F.substring(z, 1, 2))),
            ("words", F.upper(F.concat_ws("_", x, y))),
            ("words", F.concat_ws("_", x, y, number)),
            ("words", F.concat(F.initcap(x), F.initcap(y), number)),
            ("words", F.concat(x, F.lit("="), y)),
            ("words with numbers", F.concat_ws("-", F.upper(x), F.upper(y), number)),
            ("query words", F.concat(x, F.lit("/"), y, F.lit("="), number)),
        ]
        chosen = F.when(F.lit(False), F.lit(None).cast("struct<token:string,kind:string,held:boolean>"))
        for k, (kind, t) in enumerate(shapes):
            chosen = chosen.when(i % len(shapes) == k, F.struct(t.alias("token"), F.lit(kind).alias("kind"), F.lit(kind != "words").alias("held")))
        return chosen

    single = F.transform("w", lambda x: F.struct(x.alias("token"), F.lit("words").alias("kind"), F.lit(False).alias("held")))
    together = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), joined)
    return w.select(F.explode(F.concat(single, together)).alias("m")).select("m.token", F.lit(False).alias("random"), "m.kind", "m.held").distinct()


def _places(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """Spans of the leftmost non-overlapping matches of a pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind == "assign":
        good = lambda m: F.length(F.regexp_extract(m, pattern, 2)) >= 12
    elif kind == "access":
        good = lambda m: F.length(m) >= 18
    else:
        good = lambda m: F.lit(True)

    def place(pair: Column) -> Column:
        between, m = pair["between"], pair["m"]
        lengths = F.transform(m, lambda x, i: F.struct(F.length(F.get(between, i)).alias("b"), F.length(x).alias("n"), good(x).alias("ok")))
        empty = F.array().cast(SPAN)

        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + x["b"]
            one = F.array(F.struct(at.alias("s"), F.lit(rank).alias("k"), (at + x["n"]).alias("e"), F.lit(kind).alias("kind")))
            return F.struct((at + x["n"]).alias("at"), F.when(x["ok"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(lengths, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    none = F.array().cast("array<string>")
    return F.transform(
        F.array(found), lambda m: place(F.struct(F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none).alias("between"), m.alias("m")))
    )[0].cast(SPAN)


def with_spans(docs: DataFrame, model: Markov, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``secret_spans`` (base and added): arrays of
    (s start, k rank of kind, e end, kind), by start; places are code points."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*[_places(t, p, kind, rank) for rank, (kind, p) in enumerate(PATTERNS.items())])
    # Without base spans, pieces are whole runs: only texts with a random one
    # need the places of their runs.
    asked = (F.size("base_spans") > 0) | F.exists(F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)), lambda x: is_random(x, model))
    runs = F.when(asked, _places(t, CANDIDATE, "markov", len(PATTERNS))).otherwise(F.array().cast(SPAN))
    docs = docs.withColumn("base_spans", F.array_sort(base)).withColumn("__runs", runs)

    def span(s: Column, e: Column) -> Column:
        return F.struct(s.alias("s"), F.lit(len(PATTERNS)).alias("k"), e.alias("e"), F.lit("markov").alias("kind"))

    def pieces(x: Column) -> Column:
        """What base spans, which come by start, leave of a run."""
        over = F.filter("base_spans", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))
        start = F.struct(x["s"].alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, b: Column) -> Column:
            return F.struct(F.greatest(acc["at"], b["e"]).alias("at"), F.concat(acc["out"], F.array(span(acc["at"], b["s"]))).alias("out"))

        return F.aggregate(over, start, step, lambda acc: F.concat(acc["out"], F.array(span(acc["at"], x["e"]))))

    def random(x: Column) -> Column:
        return is_random(F.substring(t, x["s"] + 1, x["e"] - x["s"]), model)

    left = F.filter(F.flatten(F.transform("__runs", pieces)), lambda x: x["e"] - x["s"] >= SHORTEST)
    added = F.filter(left, random)
    return docs.withColumn("secret_spans", F.array_sort(F.concat("base_spans", added))).drop("__runs")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each maximal cover of spans replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        gap = F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))
        # At the start of the text there is nothing before, not even a span.
        new = fresh & ((x["s"] > acc["at"]) | (F.size(acc["out"]) == 0))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(new, F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def default_model(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Markov:
    spark = docs.sparkSession
    return train(random_samples(spark).unionByName(shape_samples(spark)).unionByName(ordinary_samples(docs, id_col=id_col, text=text)))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
