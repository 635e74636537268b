"""Rule-based quality filter as a short-circuit cascade.

The rules look at native document statistics. On a bounded sample the cost of
each rule (its own run time) and its selectivity (share of rows it rejects) are
measured; the rules are then chained in one CASE expression in descending order
of rejection per cost, so a row leaves at its first failing rule. The order
changes what a row costs, never its verdict: a row is kept when no rule rejects
it.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows and ties get the same verdict; an empty table gives no rows;
texts are read whole; input columns other than the text are passed through
unless they have the name of an output column, which then replaces them.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, written

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean Column over the statistics and the text."""
    name: str
    rejects: Column


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_window_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found at least twice.

    Windows are sorted with their positions, so equal windows are neighbours;
    the covered words follow from the gaps between repeated positions. All
    steps are linear or a sort, whatever the number of repeats. Windows are
    told apart by a 64-bit hash of their three words."""
    def count(ws: Column) -> Column:
        n = F.size(ws)
        windows = F.when(n >= 3, F.transform(
            F.arrays_zip(F.slice(ws, 1, n - 2).alias("a"), F.slice(ws, 2, n - 2).alias("b"), F.slice(ws, 3, n - 2).alias("c")),
            lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")))
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        def repeated(s: Column) -> Column:
            hits = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            def covered(p: Column) -> Column:
                gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
                return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)
            return let(F.array_sort(F.transform(hits, lambda x: x["i"])), covered)
        return let(F.array_sort(windows), repeated)
    return let(words, count)


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumn("_words", _words(text))
    return (out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_window_words(F.col("_words")).cast("long"),
    }).drop("_words"))


def base_rule() -> Column:
    """Too short, or over half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules(text_col: str = "text") -> list[Rule]:
    """Rules of the cascade (after the base rule); integer arithmetic, so that
    a boundary case has one answer everywhere."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    letters = F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]", ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("mean_word", (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words"))),
        Rule("duplicate_lines", 100 * F.col("n_dup_lines") > 30 * (F.length(F.regexp_replace(text, "[^\n]", "")) + 1)),
        Rule("upper_case", 2 * upper > letters),
        Rule("shouting", 5 * (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))) > F.col("n_words")),
        Rule("few_letters", 2 * F.regexp_count(text, F.lit(r"\p{L}")) < F.col("word_chars")),
    ]


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """``rules`` by rejected share per second on ``sample``, best first.

    Each rule runs alone over the stored sample; an empty sample keeps the order."""
    n = sample.count()
    if not n:
        return list(rules)
    def run(rejects: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = sample.select(F.coalesce(rejects, F.lit(False)).cast("int").alias("r")).agg(F.sum("r")).first()[0]
        return time.perf_counter() - began, hits
    idle = run(F.lit(False))[0]
    score = []
    for rule in rules:
        seconds, hits = run(rule.rejects)
        score.append(((hits / n) / max(seconds - idle, 1e-3), rule))
    return [rule for _, rule in sorted(score, key=lambda x: -x[0])]


def quality_cascade(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None,
                    sample_rows: int = 2000, seed: int = 7) -> DataFrame:
    """``df`` with the statistics, base_failed and kept.

    ``sample_rows`` bounds (in expectation) the sample on which costs and
    selectivities are estimated; it has no influence on the result."""
    rules = default_rules(text_col) if rules is None else rules
    n = df.count()
    fraction = min(1.0, sample_rows / max(n, 1))
    sample = written(statistics(df.select(text_col).sample(fraction=fraction, seed=seed), text_col)
                     .where(~base_rule()))
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order_rules(sample, rules):
        verdict = verdict.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    out = statistics(df, text_col).withColumn("base_failed", base_rule())
    return out.withColumn("kept", verdict.otherwise(F.lit("kept")) == "kept")
