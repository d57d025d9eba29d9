"""Quality rules as a short-circuit cascade.

Every text gets the base counts. Further rules reject by ratios of these and by signs of their own; what each costs
and how much it rejects is estimated on a bounded sample, and they are tried in order of rejection per cost, each only
where those before it found nothing. The order never changes a verdict.

Cases: a null or empty text has no words and fails the base rules. Words are cut at ASCII white space alone. Texts of
any length are read whole, within their row: nothing is shuffled. Repeated rows give repeated results; an empty table
gives an empty table (rules then stay as they are written).
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_SPACE = r"[\x20\x09-\x0D]+"
#: Rows on which cost and selectivity are estimated, about: those whose ids' hashes are divisible by a number.
SAMPLE_ROWS = 300
#: Turns in which a rule is worked out for its cost, runs of each job, and the least cost that is told from none.
REPEATS, RUNS, LEAST_SECONDS = 40, 2, 1e-3


def with_words(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).withColumn(
        "words", F.filter(F.split("text", _SPACE), lambda w: w != "")
    )


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once a row, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more: windows sorted with their places, equal neighbours
    marked, their places sorted, and the stretches that these cover added up."""
    def window(i: Column) -> Column:
        return F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))

    def places(windows: Column) -> Column:
        again = F.filter(windows, lambda x, k: (F.get(windows, k - 1)["w"] == x["w"]) | (F.get(windows, k + 1)["w"] == x["w"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        parts = F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(3)), F.lit(3)).cast("long"))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda total, x: total + x)

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))
    return F.when(F.size(words) >= 4, _let(_let(windows, places), covered)).otherwise(F.lit(0).cast("long"))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (
        with_words(docs)
        .withColumns(
            {
                "n_words": F.size("words").cast("long"),
                "word_chars": F.length(F.array_join("words", "")).cast("long"),
                "n_symbols": (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long"),
                "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
                "n_repeat_words": _let(F.col("words"), _repeat_words),
            }
        )
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def rules() -> dict[str, Column]:
    """What rejects a text that passed the base rules; they see the columns of `base_counts`."""
    marks = F.length("text") - F.length(F.regexp_replace("text", "!", ""))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]", ""))
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "exclamations": 10 * marks > 3 * F.col("n_words"),
        "capitals": 10 * capitals > 3 * F.col("word_chars"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        "few_words": 5 * F.size(F.array_distinct("words")) < F.col("n_words"),
    }


def ordered_rules(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejection per cost, as seen on a sample.

    A rule's cost is the time of a job that works it out `REPEATS` times for each row of the stored sample, less that of a job which
    does the same with no rule; the least of a few runs each.
    """
    every = max(1, docs.count() // rows)
    sample = common.stored(base_counts(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)))
    passed = sample.where(~F.col("base_failed"))
    again = passed.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def timed(rule: Column) -> float:
        # the turn is part of what is counted, so that each turn works the rule out anew
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            again.agg(F.count_if(rule & (F.col("turn") > 0))).first()
            took.append(time.perf_counter() - began)
        return min(took)

    known = rules()
    n, *rejected = passed.agg(F.count("*"), *(F.count_if(rule) for rule in known.values())).first()
    idle = timed(F.lit(True))
    worth = {name: k / max(1, n) / max(timed(rule) - idle, LEAST_SECONDS) for (name, rule), k in zip(known.items(), rejected)}
    return sorted(worth, key=lambda name: -worth[name])


def judged(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every whole text."""
    known = rules()
    kept = F.when(F.col("base_failed"), False)
    for name in order if order is not None else ordered_rules(docs):
        kept = kept.when(known[name], False)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return base_counts(docs).select("doc_id", *counts, "base_failed", kept.otherwise(True).alias("kept"))
