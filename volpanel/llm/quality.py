"""Quality rules whose cutoffs keep a promise on labelled texts.

Some rules are fixed. For the others - a rate above a cutoff rejects a text - the cutoffs are chosen on labelled good
texts, stratum by stratum, with the exact binomial test ``P(Bin(n, risk) <= k) <= delta`` of k false rejections of n. The
cutoffs of a rule are tested in a fixed order, from the mildest one on, and the first failure ends the sequence, which
needs no correction for its length. ``risk`` is shared out over the rules, ``delta`` over rules and strata (Bonferroni),
so with probability 1 - delta no stratum loses more than the wanted share of its good texts. A stratum needs
ln(delta / (rules x strata)) / ln(1 - risk / rules) good texts to get a cutoff at all: 459 with four strata.

Everything is DataFrame expressions; texts are never exploded, and only counts by grid step are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.session import scratch_path

RISK = 0.05
DELTA = 0.05
LEAST_WORDS = 50
RULES = {
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "duplicate_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}
STEPS = 40
TOP = {"symbol_rate": 1.0, "repeat_rate": 1.0, "duplicate_line_rate": 1.0, "word_length": 40.0}

WHITE = "' \\t\\n\\u000B\\u000C\\r'"
GAP = "'[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'"


def let(value: str, name: str, body: str) -> str:
    """``body`` with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


# Words in three-word windows that stand twice or more: equal windows are neighbours once their hashes are sorted.
REPEATED = let(
    "transform(sequence(0, size(words) - 3), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)))",
    "h",
    "CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE "
    + let(
        "array_sort(transform(h, (x, i) -> named_struct('x', x, 'i', i)))",
        "s",
        "aggregate(array_sort(filter(transform(s, (e, j) -> CASE WHEN get(s, j - 1).x = e.x OR get(s, j + 1).x = e.x THEN e.i END), "
        "i -> i IS NOT NULL)), named_struct('n', 0L, 'to', 0), "
        "(a, i) -> named_struct('n', a.n + 3 - greatest(0, a.to - i), 'to', i + 3), a -> a.n)",
    )
    + " END",
)


def measure(docs: DataFrame, id: str, text: str, stratum: str) -> DataFrame:
    """(id, stratum) and the counts of every text; a null text has no words."""
    source = docs.select(F.col(id).alias("id"), F.expr(stratum).cast("string").alias("stratum"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    by_word = let(
        f"filter(split(text, {GAP}), w -> w <> '')",
        "words",
        f"named_struct('n', bigint(size(words)), 'again', CASE WHEN size(words) < 4 THEN 0L ELSE {REPEATED} END)",
    )
    by_line = let(
        "filter(split(text, '\n'), l -> l rlike '[^ \\t\\n\\x0B\\f\\r]')",
        "lines",
        "named_struct('n', bigint(size(lines)), 'again', bigint(size(lines) - size(array_distinct(lines))))",
    )
    counted = source.selectExpr(
        "id",
        "stratum",
        f"{by_word} AS word",
        f"{by_line} AS line",
        f"bigint(char_length(translate(text, {WHITE}, ''))) AS word_chars",
        "bigint(char_length(text) - char_length(translate(text, '#*$%&|<>', ''))) AS n_symbols",
    )
    return counted.selectExpr(
        "id", "stratum", "word.n AS n_words", "word_chars", "n_symbols", "line.n AS n_lines", "line.again AS n_dup_lines", "word.again AS n_repeat_words"
    ).selectExpr("*", f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed")


def log_factorial(x: str) -> str:
    """ln(x!) by Stirling's series, taken ten places further on, where it is exact to the last digits."""
    z = f"({x} + 10D)"
    series = f"({z} + 0.5D) * ln({z}) - {z} + 0.5D * ln(2D * pi()) + 1D / (12D * {z}) - 1D / (360D * pow({z}, 3))"
    return f"({series} - {' - '.join(f'ln({x} + {i}D)' for i in range(1, 11))})"


def log_tail(n: str, k: str, risk: str) -> str:
    """Logarithm of P(Bin(n, risk) <= k) for k < n * risk.

    The terms from k down are summed as shares of the term of k. They fall faster than those of a normal density whose
    deviation is the root of k, so what lies beyond 40 deviations is below the precision of a double.
    """
    top = f"{log_factorial(n)} - {log_factorial(k)} - {log_factorial(f'({n} - {k})')} + {k} * ln({risk}) + ({n} - {k}) * ln(1 - {risk})"
    shares = (
        f"aggregate(sequence(0L, least(bigint({k}), 100L + bigint(40 * sqrt({k})))), named_struct('t', 1D, 's', 0D), (a, j) -> named_struct("
        f"'t', a.t * ({k} - j) * (1 - {risk}) / (({n} - {k} + j + 1) * {risk}), 's', a.s + a.t), a -> ln(a.s))"
    )
    return f"({top} + {shares})"


def cutoffs(good: DataFrame, risk: float, delta: float) -> DataFrame:
    """(stratum, rule, cutoff): the last cutoff before the first that fails; no row where the mildest one does."""
    steps = "stack({}, {}) AS (rule, step)".format(
        len(RULES), ", ".join(f"'{r}', int(least({STEPS}, ceil(({e}) * {STEPS} / {TOP[r]})))" for r, e in RULES.items())
    )
    counts = good.selectExpr("stratum", steps).groupBy("stratum", "rule", "step").agg(F.count("*").alias("n"))
    tables = counts.groupBy("stratum", "rule").agg(F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("by_step"), F.sum("n").alias("n"))
    strata = max(good.select("stratum").distinct().count(), 1)
    # a text is rejected by step c if its own step is larger
    tests = tables.selectExpr("stratum", "rule", "n", "by_step", f"explode(sequence(0, {STEPS - 1})) AS step").selectExpr(
        "stratum", "rule", "n", "step", "aggregate(map_entries(by_step), 0L, (a, e) -> a + CASE WHEN e.key > step THEN e.value ELSE 0L END) AS k"
    )
    own = f"({risk} / {len(RULES)})"
    passes = f"CASE WHEN k < n * {own} THEN {log_tail('n', 'k', own)} <= ln({delta} / {len(RULES) * strata}) ELSE false END"
    last = tests.groupBy("stratum", "rule").agg(F.expr(f"coalesce(max(CASE WHEN NOT {passes} THEN step END) + 1, 0) AS step"))
    tops = "CASE rule " + " ".join(f"WHEN '{r}' THEN {t}D" for r, t in TOP.items()) + " END"
    return last.where(f"step < {STEPS}").selectExpr(
        "stratum", "rule", f"step * {tops} / {STEPS} AS cutoff"
    )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    stratum: str = "lang",
    risk: float = RISK,
    delta: float = DELTA,
) -> DataFrame:
    """One row per row of ``docs``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    ``kept`` is false for texts that fail the fixed rules or exceed a cutoff of their stratum. Good texts that pass the
    fixed rules are the holdout; a stratum with too few of them gets no cutoff and loses nothing. A null or empty text
    has no words and fails; a null stratum is a stratum; repeated rows are judged one by one.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "measures")
    measure(docs, id, text, stratum).write.parquet(path)
    measured = spark.read.parquet(path)
    known = labels.select(F.col(id).alias("id"), F.col(label).alias("label")).where("label = 1").dropDuplicates(["id"])
    path = scratch_path(spark, "cutoffs")
    cutoffs(measured.where("NOT base_failed").join(known, "id", "left_semi"), risk, delta).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts")
    ).write.parquet(path)
    cuts = spark.read.parquet(path).withColumnRenamed("stratum", "of")
    over = " OR ".join(f"coalesce({e} > cuts['{r}'], false)" for r, e in RULES.items())
    joined = measured.join(cuts, F.col("stratum").eqNullSafe(F.col("of")), "left")
    return joined.selectExpr(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", f"NOT base_failed AND NOT ({over}) AS kept"
    ).withColumnRenamed("id", id)
