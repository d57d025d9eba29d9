"""Jaccard join of word shingles: links between texts whose sets of shingles are alike, their numbers and components.

Exact, by prefixes of the sets in one order of all shingles (rare ones first), with what sets have in common put to use:

* equal sets are one class, of which the smallest id is compared;
* the few shingles of lowest hash of each set name leaders, sets that a set may be much like. It is compared with those,
  and becomes a member of the family of the first to which it is related (a third of their shingles is enough). All
  links within a family are derived from what its members have in common with the leader and from how they differ from it (``families``);
* the index of prefix shingles finds the links between families and all other sets. It skips: lists of one family as a
  whole, and in the others, ordered by size, the blocks whose sizes or positions rule a link out. What is left is counted,
  and pairs that share too few prefix shingles for the rest to make up are dropped; the others are compared in full.

Families only save work: whichever sets they hold, each pair of sets is either in one family or covered by the index.

The order rests on a sample of the texts; any order gives the same result. Shingles are 64-bit hashes. A list that the
sample shows to be long is dealt to several tasks, a task for each pair of its parts. Ids that are looked up while texts
are read are broadcast if their bytes allow, and joined by a shuffle else.

A row's number of links counts rows: the others of its class and all of the classes that are similar enough.

Cases: a null text, or one without words, has an empty set and no link; its component is its own id. A text of fewer
words than a shingle has one shingle, the sequence of its words. Repeated rows are rows of one class. Rows that share an id
count as one document where components are joined. A null id has a null component, and a null number of links, unless
its class has an id. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .families import DENOMINATOR, NUMERATOR, Members, difference, weight
from .shingles import shingle_sets, slices

#: Shingles of lowest hash by which leaders are found, and leaders that a set is compared with.
HEAD, LEADERS = 8, 3
#: A member shares this part of the union with its leader: 1 / RELATED.
RELATED = 3
#: A family's sets are dealt to blocks of LEAST_BLOCK to MOST_BLOCK, BLOCKS of them if they are within that.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 256, 8192, 8
#: The order of shingles is estimated from one text in so many, but from so many texts at least; shingles in so many of
#: those are put last; of such, at most.
SAMPLE_EVERY, SAMPLE_ROWS, FREQUENT, FREQUENT_ENTRIES = 16, 4000, 3, 1_000_000
#: Entries that a task works on at once, on the average, and of a list's part.
BUCKET_ENTRIES, PART_ENTRIES = 200_000, 50_000


def ordered(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set in the common order: by hash, then the frequent ones by how frequent they are."""
    if not len(frequent) or not len(shingles):
        return shingles
    at = np.searchsorted(frequent, shingles)
    at[at == len(frequent)] = 0
    often = frequent[at] == shingles
    if not often.any():
        return shingles
    last = shingles[often][np.argsort(rank[at[often]], kind="stable")]
    return np.concatenate([shingles[~often], last])


def least_overlap(total):
    """The intersection that two sets need whose sizes add up to this."""
    return -(-NUMERATOR * total // (NUMERATOR + DENOMINATOR))


def least_size(n):
    """The size that a set similar to one of n has at least; as many shared shingles are needed."""
    return -(-NUMERATOR * n // DENOMINATOR)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that several texts of the sample share, sorted, their ranks by frequency, and into how many parts their lists go.

    The sample is a fixed share of the texts, so that the lists of the others stay as short however large the corpus.
    If there are more than `FREQUENT_ENTRIES`, those above the frequency that leaves so many.
    """
    every = min(SAMPLE_EVERY, max(1, docs.count() // SAMPLE_ROWS))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def run(batches):
        for batch in batches:
            sets = [s for part in slices(batch) for s in shingle_sets(part.column("text").to_pylist())]
            found, times = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int32))], ["shingle", "times"])

    counted = common.mapped(sample, run, "shingle long, times int").groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT)
    counted = common.stored(counted)
    least, entries = FREQUENT, 0
    by_times = counted.groupBy(F.least("times", F.lit(100_000)).alias("times")).agg(F.count("*").alias("n"))
    for row in by_times.orderBy(F.desc("times")).collect():  # at most 100,000 rows
        if entries + row.n > FREQUENT_ENTRIES:
            least = row.times + 1
            break
        entries += row.n
    rows = counted.where(F.col("times") >= least).toArrow()
    shingles, times = (np.asarray(rows.column(c).to_numpy()) for c in ("shingle", "times"))
    shingles = shingles.view(np.uint64)
    at = np.argsort(shingles)
    shingles, times = shingles[at], times[at]
    rank = np.empty(len(shingles), np.int64)
    rank[np.lexsort((shingles, times))] = np.arange(len(shingles))
    return shingles, rank, 1 + times.astype(np.int64) * every // PART_ENTRIES


def _profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n, digest of the set, its head: the shingles of lowest hash, which sets share as they share the rest."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text").to_pylist())
                heads = [s[:HEAD].view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array(heads, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "digest", "head"],
                )

    return common.mapped(docs, run, "doc_id long, n long, digest binary, head array<long>")


def _both_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, other (shingles of a), shingles (of b) of each of the pairs (a, b)."""

    def sets(batches):
        for batch in batches:
            names = [c for c in batch.schema.names if c != "text"]
            for part in slices(batch):
                blobs = [s.tobytes() for s in shingle_sets(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(blobs, pa.binary())], [*names, "shingles"])

    own = pairs.select("a", F.col("b").alias("doc_id"))
    other = pairs.select(F.col("a").alias("doc_id")).distinct()
    of_b = common.mapped(common.beside(docs, own, ["doc_id"], "inner").select(F.col("doc_id").alias("b"), "a", "text"), sets, "b long, a long, shingles binary")
    of_a = common.mapped(common.beside(docs, other, ["doc_id"], "inner").select(F.col("doc_id").alias("a"), "text"), sets, "a long, shingles binary")
    return of_b.join(of_a.withColumnRenamed("shingles", "other"), "a").select("a", "b", "shingles", "other")


def _compared(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough, by their whole sets."""

    def compare(batches):
        for batch in batches:
            similar = []
            for x, y in zip(batch.column("shingles"), batch.column("other")):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                together = np.concatenate([s, t])
                together.sort()
                shared = int((together[1:] == together[:-1]).sum())
                similar.append(DENOMINATOR * shared >= NUMERATOR * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(similar, pa.bool_()))

    return common.mapped(_both_sets(docs, pairs), compare, "a long, b long")


def _leaders(profiles: DataFrame) -> DataFrame:
    """Pairs (a, b): each class and the few leaders with which it shares most of its head."""
    heads = profiles.select("doc_id", "n", F.explode("head").alias("shingle"))
    leader = heads.groupBy("shingle").agg(F.min(F.struct("doc_id", "n")).alias("leader"), F.count("*").alias("times")).where("times > 1")
    met = (
        heads.join(leader, "shingle")
        .select(F.col("leader.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("leader.n").alias("na"), F.col("n").alias("nb"))
        .where((F.col("a") != F.col("b")) & (RELATED * F.least("na", "nb") >= F.greatest("na", "nb")))
        .groupBy("b", "a")
        .agg(F.count("*").alias("shared"))
        .where("shared > 1")
    )
    best = met.groupBy("b").agg(F.sort_array(F.collect_list(F.struct((-F.col("shared")).alias("k"), "a"))).alias("found"))  # at most HEAD entries
    return best.select("b", F.explode(F.slice(F.transform("found", lambda x: x["a"]), 1, LEADERS)).alias("a")).select("a", "b")


def _members(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """leader, doc_id, n (size), nl (the leader's), gone, more: how each set of a family differs from the leader.

    A set goes to the smallest of the leaders (a, b) to which it is related. A leader that goes to no other is a member of its own family.
    """

    def compare(batches):
        names = ["leader", "doc_id", "n", "nl", "gone", "more"]
        for batch in batches:
            rows: list[tuple] = []
            for a, b, x, y in zip(*(batch.column(c) for c in ("a", "b", "shingles", "other"))):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                gone, more = difference(s, t)
                if RELATED * (len(s) - len(more)) >= len(t) + len(more):
                    rows.append((a.as_py(), b.as_py(), len(s), len(t), gone.tobytes(), more.tobytes()))
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 4 else pa.binary()) for k, c in enumerate(columns)], names)

    related = common.mapped(_both_sets(docs, pairs), compare, "leader long, doc_id long, n long, nl long, gone binary, more binary")
    chosen = common.stored(related.groupBy("doc_id").agg(F.min(F.struct("leader", "n", "nl", "gone", "more")).alias("own")).select("doc_id", "own.*"))
    nothing = F.lit(b"")
    leaders = chosen.groupBy(F.col("leader").alias("doc_id")).agg(F.first("nl").alias("nl")).join(chosen.select("doc_id"), "doc_id", "left_anti")
    return chosen.select(*_MEMBER).union(leaders.select(F.col("doc_id").alias("leader"), "doc_id", F.col("nl").alias("n"), "nl", nothing.alias("gone"), nothing.alias("more")))


_MEMBER = ["leader", "doc_id", "n", "nl", "gone", "more"]


def _within(members: DataFrame, rows: DataFrame, parts: int, links: bool) -> DataFrame:
    """doc_id, links (rows it is linked to in its family), joins (a document of its component, or null), a row for each block.

    Without `links` only families with a set that isn't linked to its leader are looked at, and rows aren't counted.
    """
    free = weight(F.col("nl"), F.col("n"), F.length("gone") / 4) + weight(F.col("nl"), F.col("nl"), F.lit(0)) > 0
    sizes = members.groupBy("leader").agg(F.count("*").alias("size"), F.max(free).alias("free"))
    blocks = F.ceil(F.col("size") / F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.col("size") / BLOCKS)))
    sizes = common.stored(sizes.where(F.lit(links) | F.col("free")).select("leader", blocks.alias("blocks")))
    if links:
        members = members.join(rows, "doc_id")
    else:
        members = members.withColumn("rows", F.lit(1).cast("long"))
    met = (
        common.beside(members, sizes, ["leader"], "inner")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(*_MEMBER, "rows", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )

    def count(batches):
        out: list[list] = [[], [], []]

        def finished():
            columns, out[:] = [pa.array(c, pa.int64()) for c in out], [[], [], []]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "links", "joins"])

        def add(key, held):
            ids = [r[0] for r in held]
            gone, more = ([np.frombuffer(r[k], kind) for r in held] for k, kind in ((5, np.uint32), (6, np.uint64)))
            total, joined = Members(held[0][3], [r[2] for r in held], [r[1] for r in held], [r[4] == key[1] for r in held], gone, more).links(links)
            for k in np.flatnonzero((total > 0) | (joined != -2)).tolist():
                join = int(joined[k])
                for column, value in zip(out, (ids[k], int(total[k]), None if join == -2 else key[0] if join == -1 else ids[join])):
                    column.append(value)

        key, held = None, []
        for batch in batches:
            for *own, doc_id, n_rows, n, nl, block, gone, more in zip(*(batch.column(c).to_pylist() for c in ("leader", "low", "high", "doc_id", "rows", "n", "nl", "block", "gone", "more"))):
                if own != key and held:
                    add(key, held)
                    held = []
                    if len(out[0]) > 5000:
                        yield finished()
                key = own
                held.append((doc_id, n_rows, n, nl, block, gone, more))
        if held:
            add(key, held)
        yield finished()

    dealt = met.repartition(parts, "leader", "low", "high").sortWithinPartitions("leader", "low", "high")
    return common.mapped(dealt, count, "doc_id long, links long, joins long")


#: Columns of an entry of the index: shingle, cell of its list, whether it is on the cell's left, id, family, size, position.
_ENTRY = (np.uint64, np.uint32, np.uint32, np.int64, np.int64, np.uint32, np.uint32)


def _postings(docs: DataFrame, order, buckets: int) -> DataFrame:
    """bucket, entries: the prefix shingles of each set, dealt by hash, as columns of an entry.

    A list that goes into k parts has a cell for each two of them; an entry goes to the k cells of its part.
    """

    def run(batches):
        frequent, rank, parts = order.value
        for batch in batches:
            for part in slices(batch, 2000):
                ids, group = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "family"))
                prefixes, sizes = [], []
                for s in shingle_sets(part.column("text").to_pylist()):
                    n = len(s)
                    prefixes.append(ordered(s, frequent, rank)[: n - least_size(n) + 1 if n else 0])
                    sizes.append(n)
                p = np.array([len(s) for s in prefixes])
                if not p.sum():
                    continue
                shingle, owner = np.concatenate(prefixes), np.repeat(np.arange(len(p)), p)
                position = np.arange(len(shingle)) - np.repeat(np.cumsum(p) - p, p)
                entry, cell, left = cells(shingle, ids[owner], frequent, parts)
                owner = owner[entry]
                columns = [shingle[entry], cell, left, ids[owner], group[owner], np.array(sizes)[owner], position[entry]]
                columns = [c.astype(kind) for c, kind in zip(columns, _ENTRY)]
                bucket = ((columns[0] >> np.uint64(20)) + columns[1]) % np.uint64(buckets)
                at = np.argsort(bucket, kind="stable")
                columns, bucket = [c[at] for c in columns], bucket[at]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                begins, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]
                blobs = [b"".join(c[b:e].tobytes() for c in columns) for b, e in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[begins].astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "entries"])

    return common.mapped(docs, run, "bucket long, entries binary")


def cells(shingle: np.ndarray, ids: np.ndarray, frequent: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each entry the cells it goes to, as index of the entry, number of the cell, whether it is on the cell's left.

    Cell (i, j) of a list in k parts, i <= j, has the number i * k + j, with part i on the left and part j on the right.
    """
    k = np.ones(len(shingle), np.int64)
    if len(frequent) and (parts > 1).any():
        at = np.searchsorted(frequent, shingle)
        at[at == len(frequent)] = 0
        k = np.where(frequent[at] == shingle, parts[at], 1)
    part = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % k
    entry = np.repeat(np.arange(len(shingle)), k)
    other = np.arange(len(entry)) - np.repeat(np.cumsum(k) - k, k)
    own, k = part[entry], k[entry]
    return entry, np.minimum(own, other) * k + np.maximum(own, other), own <= other


def _read(blob: bytes) -> list[np.ndarray]:
    m, out, at = len(blob) // sum(np.dtype(kind).itemsize for kind in _ENTRY), [], 0
    for kind in _ENTRY:
        out.append(np.frombuffer(blob, kind, m, at))
        at += out[-1].nbytes
    return out


def list_pairs(left: np.ndarray, group: np.ndarray, size: np.ndarray, position: np.ndarray):
    """Of one cell, the index pairs of different families that sizes and positions don't rule out.

    The list is walked in order of size: what follows a set and is too large for it, and all beyond, is skipped as a
    block; so is what lies at a position from which too few shingles remain. In a cell of two parts of a list an entry
    meets those of the other part only.
    """
    order = np.lexsort((position, size))
    size, position, group, left = size[order].astype(np.int64), position[order].astype(np.int64), group[order], left[order]
    two_sides = bool((left != left[0]).any())
    last = np.searchsorted(size, DENOMINATOR * size // NUMERATOR, side="right")
    for i in range(len(order) - 1):
        j = slice(i + 1, last[i])
        if j.start >= j.stop:
            continue
        reach = np.minimum(position[i], position[j]) + np.minimum(size[i] - position[i], size[j] - position[j])
        keep = (reach >= least_overlap(size[i] + size[j])) & (group[j] != group[i])
        if two_sides:
            keep &= left[j] != left[i]
        keep = np.flatnonzero(keep)
        if len(keep):
            yield np.full(len(keep), order[i]), order[i + 1 + keep]


def bucket_pairs(columns: list[np.ndarray]):
    """Of a bucket's entries, arrays of id, id, size, size, shared shingles of the pairs that remain."""
    shingle, cell = columns[:2]
    at = np.lexsort((cell, shingle))
    shingle, cell, left, ids, group, size, position = (c[at] for c in columns)
    if not len(shingle):
        return
    begins = np.concatenate([[0], np.flatnonzero((shingle[1:] != shingle[:-1]) | (cell[1:] != cell[:-1])) + 1])
    ends = np.append(begins[1:], len(shingle))
    # a list of one family has nothing to tell, nor has a cell with its right side alone
    mixed = (np.minimum.reduceat(group, begins) != np.maximum.reduceat(group, begins)) & (np.maximum.reduceat(left, begins) == 1)
    begins, ends = begins[mixed], ends[mixed]
    found: list[tuple] = []
    waiting = 0
    for b, e in zip(begins.tolist(), ends.tolist()):
        for i, j in list_pairs(left[b:e], group[b:e], size[b:e], position[b:e]):
            found.append((i + b, j + b))
            waiting += len(i)
            if waiting > 500_000:
                yield _counted(found, ids, size)
                found, waiting = [], 0
    if found:
        yield _counted(found, ids, size)


def _counted(found: list[tuple], ids: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    i, j = (np.concatenate(c) for c in zip(*found))
    swap = ids[i] > ids[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    order = np.lexsort((ids[j], ids[i]))
    i, j = i[order], j[order]
    fresh = np.concatenate([[True], (ids[i][1:] != ids[i][:-1]) | (ids[j][1:] != ids[j][:-1])])
    starts = np.flatnonzero(fresh)
    return [ids[i[starts]], ids[j[starts]], size[i[starts]].astype(np.int64), size[j[starts]].astype(np.int64), np.diff(np.append(starts, len(i)))]


def _candidates(postings: DataFrame) -> DataFrame:
    """Pairs (a, b) that share enough prefix shingles for the rest of their sets to make up."""

    def run(batches):
        names = ["a", "b", "na", "nb", "shared"]

        def pairs_of(blobs):
            parts = [_read(b) for b in blobs]
            for pairs in bucket_pairs([np.concatenate(c) for c in zip(*parts)]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs], names)

        bucket, blobs = None, []
        for batch in batches:
            for own, blob in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist()):
                if own != bucket and blobs:
                    yield from pairs_of(blobs)
                    blobs = []
                bucket = own
                blobs.append(blob)
        if blobs:
            yield from pairs_of(blobs)

    counted = common.mapped(postings, run, "a long, b long, na long, nb long, shared long").groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    beyond = F.greatest(F.ceil(F.col("na") * NUMERATOR / DENOMINATOR), F.ceil(F.col("nb") * NUMERATOR / DENOMINATOR)) - 1
    need = F.ceil((F.col("na") + F.col("nb")) * NUMERATOR / (NUMERATOR + DENOMINATOR))
    return counted.where(F.col("shared") + beyond >= need).select("a", "b").distinct()


def similar_components(docs: DataFrame, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), n_links (rows linked to it) of every row.

    Without `links` these aren't counted and their column is left out.
    """
    spark = docs.sparkSession
    common.ship(spark)
    docs = common.id_and_text(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = spark.sparkContext.broadcast(frequent_shingles(docs))
    profiles = common.stored(_profiles(docs))
    filled = profiles.where("n > 0")
    classes = common.stored(filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")))
    copies = common.stored(
        filled.select("doc_id", "digest").join(classes.where("rows > 1").select("digest", "rep"), "digest").where("doc_id <> rep").select("doc_id", "rep").distinct()
    )
    # one set for each id: where texts share an id only the index can tell which of them is meant
    sets = filled.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("n").alias("n"), F.min("digest").alias("digest"), F.max("digest").alias("other"), F.first("head").alias("head"))
    sets = sets.where("digest = other").join(copies.select("doc_id"), "doc_id", "left_anti")
    texts = docs.where("doc_id IS NOT NULL")

    members = common.stored(_members(texts, common.stored(_leaders(sets))))
    rows = classes.select(F.col("rep").alias("doc_id"), "rows")
    within = common.stored(_within(members, rows, parts, links))
    anchored = weight(F.col("nl"), F.col("n"), F.length("gone") / 4) + weight(F.col("nl"), F.col("nl"), F.lit(0)) <= 0
    near = members.where(anchored & (F.col("doc_id") != F.col("leader"))).select("doc_id", "leader").union(within.where("joins IS NOT NULL").select("doc_id", "joins"))

    placed = members.select("doc_id", F.col("leader").alias("family"), F.lit(False).alias("copy"))
    known = common.stored(placed.unionByName(copies.select("doc_id", F.lit(None).cast("long").alias("family"), F.lit(True).alias("copy"))))
    rest = common.beside(texts, known, ["doc_id"], "left").where(~F.coalesce("copy", F.lit(False))).select("doc_id", "text", F.coalesce("family", "doc_id").alias("family"))
    entries = sets.agg(F.sum(F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1).alias("n")).first().n or 0
    dealt = _postings(rest, order, max(8 * parts, entries // BUCKET_ENTRIES)).repartition(parts, "bucket").sortWithinPartitions("bucket")
    far = common.stored(_compared(texts, common.stored(_candidates(dealt))).distinct())

    whole = common.stored(components(near.toDF("a", "b").union(far)))
    by_class = classes.join(whole, classes["rep"] == whole["node"], "left").select("digest", "rep", "rows", F.coalesce("component", "rep").alias("component_id"))
    out = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    if links:
        between = far.union(far.select("b", "a")).toDF("a", "doc_id").join(rows, "doc_id").select(F.col("a").alias("doc_id"), F.col("rows").alias("links"))
        linked = within.select("doc_id", "links").union(between).groupBy("doc_id").agg(F.sum("links").alias("links"))
        linked = common.stored(linked).withColumnRenamed("doc_id", "rep")
        of_class = F.when(F.col("rep").isNotNull(), F.col("rows") - 1 + F.coalesce("links", F.lit(0)))
        by_class = by_class.join(linked, "rep", "left").withColumn("n_links", of_class)
        out.append("n_links")
    found = filled.select("doc_id", "n", "digest").join(by_class.drop("rep", "rows", "links"), "digest", "left").select(*out)
    empty = profiles.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return found.union(empty.select(*out))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest id; all columns. Rows with a null id stay."""
    found = similar_components(docs, links=False)
    gone = common.stored(found.where("doc_id <> component_id").select("doc_id").distinct())
    return common.beside(docs, gone, ["doc_id"], "left_anti")
