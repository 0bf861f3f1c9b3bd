"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Fixed base rules come first.  The other rules each reject a text whose measure is
above a cutoff.  All cutoffs of a stratum (language) are chosen together on labelled
rows, so that the rules as a whole reject at most ``risk`` of its good texts:

1. A quarter of the labelled rows, by hash and of all strata, is the design set.  It
   orders vectors of cutoffs from loose to strict: at each level a rule takes its
   strictest cutoff that rejects at most that level's share of good design rows and
   at least LIFT times as large a share of bad ones, or none.
2. The other rows are the holdout.  In each stratum the vectors are tested in that
   order: the exact binomial tail tests whether the joint rejection of good texts may
   be above ``risk``, and the last vector before the first failure is used (a fixed
   sequence of tests needs no correction among its levels).  The strata share the
   error ``delta`` (Bonferroni), so with probability 1 - delta no stratum rejects more
   than ``risk`` of its good texts by these rules.

A trial is a distinct text: copies of one text are one.  A stratum whose holdout is
too small for the loosest vector (under about 220 good texts at 2 %, 5 % and four
strata) gets no cutoffs and rejects nothing.

Texts are measured once, without a shuffle, and the measures are written to the
shared folder; choosing cutoffs and judging read only those.

Equal windows of words are found by 64-bit hashes within one text.

Defined results: a null or empty text has no words, so it fails the base rules;
texts of any length are measured whole; a null stratum is one of its own; labels
that are null are left out, repeated ones averaged; repeated rows are judged alike;
an empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._io import stored

SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"

#: Measure of each rule and its cutoffs, loosest first.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", tuple(round(3.0 * 0.85**k, 6) for k in range(28))),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", tuple(round(1 - 0.04 * k, 6) for k in range(1, 24))),
    "repeat_words": ("n_repeat_words / n_words", tuple(round(0.3 - 0.01 * k, 6) for k in range(0, 29))),
    "long_words": ("word_chars / n_words", tuple(round(30 * 0.93**k, 6) for k in range(26))),
    "short_words": ("- word_chars / n_words", tuple(round(-1 - 0.15 * k, 6) for k in range(24))),
    "capitals": ("n_capitals / greatest(word_chars, 1)", tuple(round(0.9 * 0.88**k, 6) for k in range(24))),
}
#: Shares of good design rows that a rule may reject, level by level.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.004, 0.006, 0.008, 0.01, 0.0125, 0.015, 0.02)
LIFT = 5.0  # a cutoff must reject this many times as large a share of bad rows
DESIGN = 4  # one of so many labelled texts is in the design set
MAX_BROADCAST_STRATA = 4096  # cutoffs of so many strata are broadcast; more are joined by a shuffle


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum, a hash of the text, and the measures of each text."""
    t = F.coalesce(F.col("__t"), F.lit(""))
    one = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("__stratum"), F.col(text_col).cast("string").alias("__t"))
    without = lambda kept: (F.length(t) - F.length(F.regexp_replace(t, kept, ""))).cast("long")
    two = one.select(
        "__id",
        "__stratum",
        F.xxhash64("__t").alias("__text"),
        F.array_remove(F.split(t, f"[{SPACES}]+", -1), "").alias("__w"),
        without("[" + SYMBOLS.replace("&", "\\&") + "]+").alias("n_symbols"),
        without("[A-Z]+").alias("n_capitals"),
        F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("__lines"),
    )
    n = F.size("__w")
    three = two.select(
        "__id", "__stratum", "__text", n.cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"), "n_symbols", "n_capitals",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 8, F.transform("__w", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<long>")).alias("__x"),
    )
    # eight words as one hash of their hashes; the last seven places have no window
    window = F.transform("__x", lambda x, i: F.when(i + 7 < F.col("n_words"), F.xxhash64(x, *[F.get("__x", i + k) for k in range(1, 8)])))
    four = three.select(*[c for c in three.columns if c != "__x"], F.slice(window, 1, F.greatest(F.size("__x") - 7, F.lit(0))).alias("__h"))
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    five = four.select(*[c for c in four.columns if c != "__h"], F.when(again, pairs).alias("__s"))
    near = F.transform("__s", lambda x, k: F.when((x.h == F.get("__s", k - 1).h) | (x.h == F.get("__s", k + 1).h), x.i))
    six = five.select(*[c for c in five.columns if c != "__s"], F.when(F.col("__s").isNotNull(), F.sort_array(F.array_compact(near))).alias("__p"))
    gaps = F.zip_with("__p", F.slice("__p", F.lit(2), F.size("__p")), lambda a, b: F.least(F.lit(8), F.coalesce(b - a, F.lit(8))))
    repeat = F.when(F.col("__p").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda s, g: s + g)).cast("long")
    return six.select(*[c for c in six.columns if c != "__p"], repeat.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _tail(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X binomial(n, p), summed exactly in logs."""
    import math

    start = n * math.log1p(-p)
    step = lambda a, i: a.t + F.log((n - i + 1) / i) + F.lit(math.log(p / (1 - p)))

    def add(a: Column, i: Column) -> Column:
        t = step(a, i)
        return F.struct(t.alias("t"), (F.greatest(a.s, t) + F.log1p(F.exp(-F.abs(a.s - t)))).alias("s"))

    first = F.struct(start.cast("double").alias("t"), start.cast("double").alias("s"))
    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(terms, first, add, lambda a: a.s)


def labelled(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(stratum, the measures, good, design) of each distinct labelled text that passes the base rules."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).where("__id is not null and __y is not null").groupBy("__id").agg(F.avg("__y").alias("__y"))
    rows = measured.where(~base_failed()).join(known, "__id")
    values = [c for c in measured.columns if c not in ("__id", "__stratum", "__text")]
    rows = rows.groupBy("__stratum", "__text").agg((F.avg("__y") >= 0.5).alias("good"), *[F.first(c).alias(c) for c in values])
    return rows.withColumn("design", F.pmod(F.xxhash64("__text", F.lit("design")), F.lit(DESIGN)) == 0)


def vectors(rows: DataFrame) -> DataFrame:
    """One row: per rule its cutoffs by level, from loose to strict, null where it has none."""
    grids = {r: F.array(*map(F.lit, cuts)) for r, (_, cuts) in RULES.items()}
    # how many of a rule's cutoffs each row is above: cutoffs fall, so that says by which it is rejected
    passed = lambda r, m: F.size(F.filter(grids[r], lambda c: F.expr(m) > c))
    above = F.array(*[F.struct(F.lit(r).alias("rule"), passed(r, m).alias("above")) for r, (m, _) in RULES.items()])
    counts = rows.where("design").select("good", F.explode(above).alias("x")).groupBy("x.rule", "x.above").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    tables = counts.groupBy("rule").agg(F.collect_list(F.struct("above", "good", "bad")).alias("m"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    grid = F.element_at(F.create_map(*[x for r in RULES for x in (F.lit(r), grids[r])]), F.col("rule"))
    size = F.size(grid)
    hit = lambda j, c: F.aggregate("m", F.lit(0).cast("long"), lambda s, e: s + F.when(e["above"] >= size - j + 1, e[c]).otherwise(0))
    steps = F.transform(F.sequence(F.lit(1), size), lambda j: F.struct(j.alias("j"), hit(j, "good").alias("good"), hit(j, "bad").alias("bad")))

    def at(level: float):
        allowed = F.filter("steps", lambda e: (e["good"] <= level * F.col("good")) & (e["bad"] > 0) & (e["bad"] * F.col("good") >= LIFT * e["good"] * F.col("bad")))
        return F.get("grid", F.array_max(F.transform(allowed, lambda e: e["j"])) - 1)

    chosen = tables.select("rule", "good", "bad", grid.alias("grid"), steps.alias("steps")).select("rule", F.array(*map(at, LEVELS)).alias("cuts"))
    return chosen.agg(*[F.max(F.when(F.col("rule") == r, F.col("cuts"))).alias(f"cuts_{r}") for r in RULES])


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, one column per rule): the chosen cutoffs, null where there is none."""
    rows = labelled(measured, labels, id_col, label_col)
    order = vectors(rows)
    every = F.sequence(F.lit(1), F.lit(len(LEVELS)))
    rejected = lambda j: F.coalesce(F.greatest(*[F.coalesce((F.expr(m) > F.get(f"cuts_{r}", j - 1)).cast("int"), F.lit(0)) for r, (m, _) in RULES.items()]), F.lit(0)) == 1
    tested = rows.where("good and not design").join(F.broadcast(order))  # one row
    first = F.array_min(F.filter(every, rejected))  # the loosest vector that rejects the text
    counts = tested.select("__stratum", first.alias("first")).groupBy("__stratum", "first").count()
    tables = counts.groupBy("__stratum").agg(F.collect_list(F.struct("first", "count")).alias("m"), F.sum("count").alias("n"))
    strata = tables.agg(F.count("*").alias("strata"))
    tables = tables.join(F.broadcast(strata))  # one row
    wrong = lambda j: F.aggregate("m", F.lit(0).cast("long"), lambda s, e: s + F.when(e["first"] <= j, e["count"]).otherwise(0))
    limit = F.log(F.lit(delta) / F.col("strata"))
    passes = F.transform(every, lambda j: F.when(wrong(j) < F.col("n") * risk, _tail(wrong(j), F.col("n"), risk) <= limit).otherwise(F.lit(False)))
    last = F.when(F.array_position("ok", False) > 0, F.array_position("ok", False) - 1).otherwise(F.lit(len(LEVELS))).cast("int")
    chosen = tables.select("__stratum", passes.alias("ok")).select("__stratum", last.alias("level")).join(F.broadcast(order))
    return chosen.select("__stratum", *[F.when(F.col("level") > 0, F.get(f"cuts_{r}", F.col("level") - 1)).alias(f"cut_{r}") for r in RULES])


def judge(df: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """id, the measures, base_failed, rejected_by (array of rules), kept; one row per input row."""
    measured = stored(measure(df, id_col, text_col, stratum_col), "measures")
    chosen = stored(cutoffs(measured, labels, risk, delta, id_col, label_col), "cutoffs")
    if chosen.count() <= MAX_BROADCAST_STRATA:
        chosen = F.broadcast(chosen)
    both = measured.join(chosen, "__stratum", "left")
    by = F.array_compact(F.array(*[F.when((F.col("n_words") > 0) & (F.expr(m) > F.col(f"cut_{r}")), F.lit(r)) for r, (m, _) in RULES.items()]))
    out = both.withColumn("base_failed", base_failed()).withColumn("rejected_by", by)
    return out.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by", "n_lines", "n_capitals")
