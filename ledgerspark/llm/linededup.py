"""Line deduplication: repeated runs of lines, found by a suffix array over line ids, are deleted but for the first copy.

The corpus is one sequence of line ids, broken after each document. Prefix doubling ranks what stands at each place:
equal lines first, then stretches of 2, 4, 8 ... lines, each level's ranks being the order of pairs of the level
before it, by a range-partitioned sort. Places whose stretch is unique leave; they can't start a repeated run.

Two stretches that cover a run's first `min_words` words (whole lines, their ends overlapping) name it: places that
share such a name are an interval of the suffix array whose common prefix is at least that long. The first place of an
interval stays. The others are later copies: each is deleted as far as it equals the first, which is its longest
common prefix, found level by level. A run of fewer words isn't touched. `MIN_WORDS` is one: every line with
a word that stands anywhere before is deleted, however short, and lines without a word go with the runs they stand in.

Places are ordered by document id and line. Documents with the same id and text are one document here: both are cut
alike. Cases: null and empty texts have no lines and stay as they are. A null id comes after all others. Runs may
overlap their first copy. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words that a repeated run has at least: one, so that a single line is a run.
MIN_WORDS = 1
_KEY = ["d", "u"]
_LAST = (1 << 63) - 1


def _key() -> tuple:
    """The documents' keys: d orders them (null last), u tells texts with one id apart."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with their keys."""
    d, u = _key()
    return docs.withColumns({"d": d, "u": u})


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line: d, u, i, its 128-bit hash (h, g), and how many lines from here hold `min_words` words (0: too few)."""
    common.ship(docs.sparkSession)
    names = ["d", "u", "i", "h", "g", "m"]

    def run(batches):
        import xxhash

        for batch in batches:
            d, u = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "u"))
            for begin in range(0, batch.num_rows, 500):
                out: list[list] = [[] for _ in names]
                for k in range(begin, min(begin + 500, batch.num_rows)):
                    text = (batch.column("text")[k].as_py() or "").encode()
                    if not text:
                        continue
                    lines = text.split(b"\n")
                    n = len(lines)
                    before = np.concatenate([[0], np.cumsum([len(line.split()) for line in lines])])
                    ends = np.searchsorted(before, before[:-1] + min_words, side="left")
                    m = np.where(ends <= n, ends - np.arange(n), 0)
                    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(line) for line in lines), np.int64).reshape(n, 2)
                    for column, value in zip(out, (np.full(n, d[k]), np.full(n, u[k]), np.arange(n), digests[:, 0], digests[:, 1], m)):
                        column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names)

    return common.mapped(_keyed(common.id_and_text(docs)).select("d", "u", "text"), run, ", ".join(f"{c} long" for c in names))


def _ranked(pairs: DataFrame) -> DataFrame:
    """Distinct (x, y) that occur more than once and their rank r in the order of (x, y)."""
    shared = pairs.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    # ids rise with the partition and within it, so over ranges they are ranks
    return common.stored(shared.repartitionByRange("x", "y").sortWithinPartitions("x", "y").select("x", "y", F.monotonically_increasing_id().alias("r")))


def _levels(lines: DataFrame) -> list[DataFrame]:
    """Of each level k the places d, u, i whose 2^k lines occur elsewhere too, with their rank r."""
    first = lines.select(*_KEY, "i", F.col("h").alias("x"), F.col("g").alias("y"))
    levels = [common.stored(first.join(_ranked(first), ["x", "y"]).select(*_KEY, "i", "r").dropDuplicates([*_KEY, "i"]))]
    while True:
        now, step = levels[-1], 1 << (len(levels) - 1)
        after = now.select(*_KEY, (F.col("i") - step).alias("i"), F.col("r").alias("y"))
        pairs = now.withColumnRenamed("r", "x").join(after, [*_KEY, "i"])
        level = common.stored(pairs.join(_ranked(pairs), ["x", "y"]).select(*_KEY, "i", "r"))
        if level.isEmpty():
            return levels
        levels.append(level)


def _later_copies(lines: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Places d, u, i that begin like an earlier place fd, fu, fi, for m lines at least."""
    every = reduce(DataFrame.union, [level.select(F.lit(k).alias("k"), *_KEY, "i", "r") for k, level in enumerate(levels)])
    # of m lines the largest power of two that fits, 2^k, from either end
    own = lines.where("m > 0").select(*_KEY, "i", "m", (F.length(F.bin("m")) - 1).alias("k")).where(F.col("k") < len(levels))
    begin = own.join(every, ["k", *_KEY, "i"]).withColumnRenamed("r", "x").withColumn("j", F.expr("i + m - shiftleft(1L, k)"))
    end = every.select("k", *_KEY, F.col("i").alias("j"), F.col("r").alias("y"))
    named = common.stored(begin.join(end, ["k", *_KEY, "j"]).select(*_KEY, "i", "m", "x", "y", "k").dropDuplicates([*_KEY, "i"]))
    intervals = named.groupBy("k", "m", "x", "y").agg(F.min(F.struct("d", "u", "i")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = named.join(intervals, ["k", "m", "x", "y"]).select(*_KEY, "i", "m", F.col("first.d").alias("fd"), F.col("first.u").alias("fu"), F.col("first.i").alias("fi"))
    return copies.where("d <> fd OR u <> fu OR i <> fi")


def _extended(copies: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Maximal runs d, u, i, length: later copies as far as they equal their first copy.

    A copy that follows on another's run is within it and needs no run of its own.
    """
    follows = copies.select(*_KEY, (F.col("i") + 1).alias("i"), "fd", "fu", (F.col("fi") + 1).alias("fi"))
    runs = copies.join(follows, [*_KEY, "i", "fd", "fu", "fi"], "left_anti").withColumnRenamed("m", "length")
    for k in range(len(levels) - 1, -1, -1):
        # at most one step of each size after the largest, which may repeat no further: lengths add up in binary
        here = levels[k].select(*_KEY, F.col("i").alias("at"), F.col("r").alias("r1"))
        there = levels[k].select(F.col("d").alias("fd"), F.col("u").alias("fu"), F.col("i").alias("fat"), F.col("r").alias("r2"))
        runs = common.stored(
            runs.withColumns({"at": F.col("i") + F.col("length"), "fat": F.col("fi") + F.col("length")})
            .join(here, [*_KEY, "at"], "left")
            .join(there, ["fd", "fu", "fat"], "left")
            .select(*_KEY, "i", "fd", "fu", "fi", F.when(F.col("r1") == F.col("r2"), F.col("length") + (1 << k)).otherwise(F.col("length")).alias("length"))
        )
    return runs.select(*_KEY, "i", "length")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, u, runs (array of start line and length) of every document that holds later copies."""
    lines = common.stored(_lines(docs, min_words))
    levels = _levels(lines)
    copies = common.stored(_later_copies(lines, levels))
    return _extended(copies, levels).groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("i", "length"))).alias("runs"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of the table, later copies of runs deleted from `text`, and n_lines, n_deleted.

    Columns that the table already has under those names, in any case, are replaced.
    """
    own = {c: f"{c}_{uuid.uuid4().hex}" for c in ("d", "u", "runs")}  # no name of the table's can clash
    runs = common.stored(repeated_runs(docs, min_words)).withColumnsRenamed(own)
    d, u = _key()
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    kept = [F.col(c).cast("string").alias(c) if c.lower() == "text" else F.col(c) for c in names]
    joined = common.beside(docs.select(*kept, d.alias(own["d"]), u.alias(own["u"])), runs, [own["d"], own["u"]], "left").select(*names, own["runs"])
    where = [c.lower() for c in names].index("text")
    schema = T.StructType([*joined.schema.fields[:-1], T.StructField("n_lines", T.LongType()), T.StructField("n_deleted", T.LongType())])

    def run(batches):
        for batch in batches:
            texts, counts, deleted = [], [], []
            for text, found in zip(batch.column(where), batch.column(batch.num_columns - 1)):
                text, found = text.as_py(), found.as_py()
                lines = text.split("\n") if text else []
                gone = set()
                for r in found or ():
                    gone.update(range(r["i"], r["i"] + r["length"]))
                texts.append("\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else text)
                counts.append(len(lines))
                deleted.append(len(gone))
            columns = [pa.array(texts, pa.string()) if k == where else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(deleted, pa.int64())], [f.name for f in schema.fields])

    return common.mapped(joined, run, schema)


def line_digests(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted, text_sha256 (of what remains) of every document."""
    return deduplicated(common.id_and_text(docs), min_words).select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
