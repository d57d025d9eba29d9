"""Exact duplicates by a content sort.

Texts are compared after lower-casing A-Z only, byte for byte. Each task first folds the copies it meets into one row
with all their ids (salting and pre-aggregation in one: a group that holds a third of all rows leaves a task as few rows).
Sampled splitters then range-partition the texts by their leading bytes and, where those tie, a digest; an external sort
within each range places equal texts next to each other, and neighbours are compared in full. What the sort finds goes
back to the rows by the ids that it carries: rows of a run in one piece are answered on the spot, the pieces of longer
runs are joined to the run's answer, a few rows each.

Cases: a null text counts as empty, and equals an empty one. Repeated rows are members like any other. A null doc_id
is never the one that stays unless all of a group's ids are null. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import string
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Leading bytes by which texts are first sorted; splitters that Spark samples stay this small.
LEAD = 24
#: Rows whose copies are folded together before they leave a task.
FOLD_ROWS = 2000
UPPER = string.ascii_uppercase


def normalised(text: str | None) -> bytes:
    """A text's UTF-8 bytes with A-Z in lower case (bytes.lower touches ASCII only)."""
    return (text or "").encode().lower()


def _folded(docs: DataFrame) -> DataFrame:
    """One row for each distinct text of a stretch of rows: lead, digest, norm, the ids of its rows."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, FOLD_ROWS):
                part = batch.slice(k, FOLD_ROWS)
                found: dict[bytes, list] = {}
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                    found.setdefault(normalised(text.as_py()), []).append(doc_id)
                norms = list(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([n[:LEAD] for n in norms], pa.binary()),
                        pa.array([hashlib.sha256(n).digest() for n in norms], pa.binary()),
                        pa.array(norms, pa.binary()),
                        pa.array(found.values(), pa.list_(pa.int64())),
                    ],
                    ["lead", "digest", "norm", "ids"],
                )

    return common.mapped(common.id_and_text(docs), run, "lead binary, digest binary, norm binary, ids array<long>")


def _neighbours(keep: str):
    """Over a sorted stream: runs of equal texts, compared in full.

    A run of one row leaves as group (null), digest, ids, keep_id, group_size. The rows of a longer run leave as group,
    digest, ids, and after them a row of group, keep_id, group_size.
    """
    best = max if keep == "largest" else min
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def chosen(a, b):
        return b if a is None else a if b is None else best(a, b)

    def run(batches):
        task, runs, out = TaskContext.get().partitionId(), 0, []

        def batch_of():
            rows, out[:] = list(zip(*out)), []
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(rows, kinds)], ["run", "digest", "ids", "keep_id", "group_size"])

        # the run's text, its number once it has a second row, its first row until then, its answer
        current = number = first = stays = None
        size = 0

        def ended():
            if number is not None:
                out.append((number, None, None, stays, size))
            elif first is not None:
                out.append((None, *first, stays, size))

        for batch in batches:
            for norm, digest, ids in zip(batch.column("norm"), batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
                norm = norm.as_py()
                own = reduce(chosen, ids)
                if norm == current:
                    if number is None:
                        number = task << 33 | runs
                        runs += 1
                        out.append((number, *first, None, None))
                    out.append((number, digest, ids, None, None))
                    stays, size = chosen(stays, own), size + len(ids)
                else:
                    ended()
                    current, number, first, stays, size = norm, None, (digest, ids), own, len(ids)
                if len(out) >= 2000:
                    yield batch_of()
        ended()
        if out:
            yield batch_of()

    return run


def _answers(docs: DataFrame, keep: str) -> DataFrame:
    """doc_id, digest, keep_id, group_size of every row."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    common.ship(docs.sparkSession)
    ranged = _folded(docs).repartitionByRange("lead", "digest").sortWithinPartitions("lead", "digest", "norm")
    found = common.stored(common.mapped(ranged, _neighbours(keep), "run long, digest binary, ids array<long>, keep_id long, group_size long"))
    at_once = found.where("run IS NULL").drop("run")
    of_runs = found.where("run IS NOT NULL AND ids IS NULL").select("run", "keep_id", "group_size")
    pieces = found.where("run IS NOT NULL AND ids IS NOT NULL").select("run", "digest", "ids").join(of_runs, "run").drop("run")
    return at_once.unionByName(pieces).select(F.explode("ids").alias("doc_id"), "digest", "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; `keep` names the id that stays (smallest, largest).

    Rows that repeat both text and id are all marked kept when theirs is the id that stays.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return _answers(docs, keep).select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows that stay, all columns: of each group of equal texts one row with the id that stays.

    Of rows that repeat that id and text, whatever their other columns hold, any one stays; so it is for ids that are null.
    """
    answers = _answers(docs, keep)
    verdicts = answers.groupBy("doc_id", "digest").agg(F.first(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("stays"), F.count("*").alias("n"))
    verdicts = common.stored(verdicts.where("n > 1 OR NOT stays").select("doc_id", "digest", "stays"))
    # the table's columns in one struct: no name can clash
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.translate(text, UPPER, UPPER.lower()).cast("binary"), 256))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.struct(*docs.columns).alias("row"))
    known = common.beside(held, verdicts, ["doc_id", "digest"], "left", null_safe=True)
    alone = known.where("stays IS NULL").select("row.*")
    repeated = known.where("stays").groupBy("doc_id", "digest").agg(F.first("row").alias("row")).select("row.*")
    return alone.unionAll(repeated)
