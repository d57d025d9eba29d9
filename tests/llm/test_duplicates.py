"""Exact, line and near duplicates, and components, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from ledgerspark.llm import exactdedup, families, jaccard, linededup, shingles as shingling
from ledgerspark.llm.components import components


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def test_exact_duplicates(documents, odd, nothing):
    for table in (documents, odd):
        for keep, best in (("smallest", min), ("largest", max)):
            groups = defaultdict(list)
            for r in table.select("doc_id", "text").collect():
                groups[lowered(r.text)].append(r.doc_id)
            want = []
            for text, ids in groups.items():
                stays = best((i for i in ids if i is not None), default=None)
                want += [repr((i, stays, len(ids), i == stays, hashlib.sha256(text.encode()).hexdigest())) for i in ids]
            assert sorted(repr(tuple(r)) for r in exactdedup.exact_duplicates(table, keep).collect()) == sorted(want)
    assert exactdedup.exact_duplicates(nothing).count() == 0
    with pytest.raises(ValueError):
        exactdedup.exact_duplicates(odd, "first")


def test_rows_that_stay(odd, documents):
    kept = exactdedup.without_copies(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 3, 4, 5, 13} <= set(ids) and not {2, 6, 14} & set(ids)  # null and empty are equal
    texts = [lowered(r.text) for r in exactdedup.without_copies(documents).collect()]
    assert len(texts) == len(set(texts)) == len({lowered(r.text) for r in documents.collect()})


def test_one_row_stays_whatever_the_columns_are_called(spark):
    rows = [(1, "A", 1), (1, "a", 2), (2, "a", 3), (None, "a", 4), (3, "b", 5), (3, "c", 6), (None, "d", 7), (None, "D", 8), (None, None, 9), (4, "", 10), (4, None, 11)]
    table = spark.createDataFrame([(*r, b"x", b"y", 1, 1) for r in rows], "doc_id long, text string, n long, digest binary, _digest_of_text binary, stays int, KEEP_ID int").repartition(3)
    kept = exactdedup.without_copies(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept.collect()) == [(0, "d"), (1, "a"), (3, "b"), (3, "c"), (4, "")]


def test_a_run_over_many_folds_has_one_answer(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "FOLD_ROWS", 3)
    rows = [(k, "same" if k % 2 else f"own {k % 20}") for k in range(200)]
    for keep, best in (("smallest", min), ("largest", max)):
        groups = defaultdict(list)
        for k, t in rows:
            groups[t].append(k)
        got = exactdedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), keep).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted((k, best(g), len(g)) for g in groups.values() for k in g)


def test_many_copies_over_many_partitions(spark):
    rows = [(k, "The Same Text" if k % 3 else f"text {k % 50}") for k in range(5_000)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exactdedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()}
    groups = defaultdict(list)
    for k, t in rows:
        groups[t].append(k)
    assert got == {k: (min(g), len(g)) for g in groups.values() for k in g}


def shingles(text, n=5):
    words = lowered(text).encode().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def near(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_of_documents(documents, odd, nothing):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(documents).collect()} == near([(r.doc_id, r.text) for r in documents.collect()])
    rows = jaccard.similar_components(odd).collect()
    assert len(rows) == odd.count()
    want = near({(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert jaccard.similar_components(nothing).count() == 0


def test_chains_copies_and_shared_passages(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows, i = [], 0
    for _ in range(12):  # families in which neighbours are alike and the ends are not, all with one passage
        text = [rng.choice(words) for _ in range(rng.randint(12, 160))]
        for _ in range(8):
            i += 1
            rows.append((i, " ".join(text + (passage if i % 2 else []))))
            if rng.random() < 0.5:
                i += 1
                rows.append((i, rows[-1][1].upper() if rng.random() < 0.5 else rows[-1][1].replace(" ", "\n")))
            for _ in range(rng.randint(1, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
    rows += [(1000 + k, " ".join(words[k : k + n])) for k, n in enumerate((1, 2, 3, 4, 5, 6, 4, 5))] + [(2000, " ".join(words[:3])), (2001, " ".join(words[1:3]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(df).collect()} == near(rows)
    kept = {r.doc_id for r in jaccard.one_of_each(df).collect()}
    assert kept == {c for _, c in near(rows).values()}


def links(rows):
    sets = [shingles(t) for _, t in rows]
    similar = lambda s, t: bool(s and t) and 100 * len(s & t) >= 75 * len(s | t)
    return sorted((i, sum(similar(s, t) for t in sets) - bool(s)) for (i, _), s in zip(rows, sets))


def test_links_are_all_counted(spark, documents, odd):
    """Near copies with different texts, of which not all are linked, in several blocks; copies; links between groups."""
    rng = random.Random(7)
    text = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(330):
        own = list(text)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(900)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, rows[i][1].upper()) for i in range(0, 330, 7)] + [(2000, ""), (2001, None), (2002, "alone " * 9)]
    edges = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("doc_id", "n_links").collect()
    want = links(rows)
    assert len({n for _, n in want}) > 20 and sorted(map(tuple, edges)) == want
    for table in (documents, odd):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        got = [(r.doc_id, r.n_links) for r in jaccard.similar_components(table).collect()]
        assert sorted(r for r in got if r[0] is not None) == [r for r in links([r for r in rows if r[0] is not None])]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5])
def test_slices_of_few_words(n):
    words = "a b c d e".split()[:n]
    assert [len(s) for s in shingling.shingle_sets([" ".join(words)])] == [min(n, 1)]
    alone, beside = shingling.shingle_sets([" ".join(words)])[0], shingling.shingle_sets(["f g h i j k", " ".join(words)])[1]
    assert alone.tolist() == beside.tolist()


def test_table_of_one_short_text(spark):
    got = jaccard.similar_components(spark.createDataFrame([(278, "Anouble thwh.")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(278, 1, 278, 0)]


@pytest.mark.parametrize("parts", [1, 3])
def test_lists_lose_no_pair(parts):
    """Pairs that prefixes, sizes, positions and counts leave are a superset of the links, whatever the order and the cells."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = rng.choice(200, rng.integers(4, 60), replace=False)
        sets = []
        for _ in range(12):
            s = set(base[rng.random(len(base)) > rng.random() * 0.3].tolist()) | set(rng.integers(200, 400, rng.integers(0, 6)).tolist())
            sets.append(np.array(sorted(s), np.uint64))
        rows = [[], [], [], []]
        for k, s in enumerate(sets):
            p = len(s) - jaccard.least_size(len(s)) + 1 if len(s) else 0
            for column, value in zip(rows, (s[:p], np.full(p, k), np.full(p, len(s)), np.arange(p))):
                column.append(value)
        shingle, ids, size, position = (np.concatenate(c) for c in rows)
        long = np.unique(shingle)[::2]
        entry, cell, left = jaccard.cells(shingle, ids, long, np.full(len(long), parts))
        shared = defaultdict(int)
        for part in jaccard.bucket_pairs([shingle[entry], cell, left, ids[entry], ids[entry], size[entry], position[entry]]):
            for a, b, *_, c in zip(*part):
                shared[(a, b)] += c
        for a in range(12):
            for b in range(a + 1, 12):
                na, nb = len(sets[a]), len(sets[b])
                both = len(np.intersect1d(sets[a], sets[b]))
                assert shared[(a, b)] <= both
                if na and nb and 100 * both >= 75 * (na + nb - both):
                    beyond = max(jaccard.least_size(na), jaccard.least_size(nb)) - 1
                    assert shared[(a, b)] + beyond >= jaccard.least_overlap(na + nb)


@pytest.mark.parametrize("one_side", [True, False])
def test_links_from_differences(one_side, monkeypatch):
    """Links of a family's sets, their numbers and what they join, against whole sets; leaders near and far, empty ones too."""
    monkeypatch.setattr(families, "ROWS", 7)
    monkeypatch.setattr(families, "COLUMNS", 11)
    monkeypatch.setattr(families, "WIDTH", 5)
    rng = np.random.default_rng(8)
    for turn in range(40):
        leader = np.unique(rng.integers(0, 1 << 40, rng.integers(0 if turn < 4 else 5, 60)).astype(np.uint64))
        extra = rng.integers(1 << 40, 1 << 41, 40).astype(np.uint64)
        sets = [np.union1d(leader[rng.random(len(leader)) > rng.random() * 0.5], rng.choice(extra, rng.integers(0, 12))) for _ in range(40)] + [leader]
        rows, left = rng.integers(1, 5, len(sets)), np.ones(len(sets), bool) if one_side else rng.random(len(sets)) < 0.5
        gone, more = zip(*(families.difference(s, leader) for s in sets))
        for s, g, m in zip(sets, gone, more):
            assert np.array_equal(np.union1d(np.delete(leader, g), m), s)
        both = np.array([[len(np.intersect1d(s, t)) for t in sets] for s in sets])
        size = np.array([len(s) for s in sets])
        linked = 100 * both >= 75 * (size[:, None] + size[None, :] - both)
        linked &= ~np.eye(len(sets), dtype=bool) if one_side else left[:, None] != left[None, :]
        members = families.Members(len(leader), size, rows, left, list(gone), list(more))
        total, joined = members.links()
        assert total.tolist() == (linked @ rows).tolist()
        by_leader = 100 * both[:, -1] >= 75 * (size + len(leader) - both[:, -1])
        assert members.anchored.tolist() == by_leader.tolist()
        uncounted = families.Members(len(leader), size, rows, left, list(gone), list(more)).links(counted=False)[1]
        assert uncounted.tolist() == joined.tolist()
        # components by these links and those to the leader (node -1), and by what is joined
        def parts(pairs):
            at = list(range(len(sets) + 1))
            for a, b in pairs:
                at = [min(at[a], at[b]) if x in (at[a], at[b]) else x for x in at]
            return at
        hub = len(sets)
        anchors = [(k, hub) for k in np.flatnonzero(by_leader).tolist()]
        assert parts(anchors + np.argwhere(linked).tolist()) == parts(anchors + [(k, hub if j == -1 else int(j)) for k, j in enumerate(joined.tolist()) if j != -2])


def test_long_lists_are_dealt_in_cells(spark, monkeypatch):
    """Any list of more than a few entries goes into parts; the links are the same."""
    monkeypatch.setattr(jaccard, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(jaccard, "PART_ENTRIES", 3)
    monkeypatch.setattr(jaccard, "RELATED", 1)  # families of equal sets alone, so that the index has all the work
    rng = random.Random(3)
    text = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else f"x{rng.randrange(50)}" for w in text)) for i in range(120)]
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == links(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near(rows)


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(500, 500), (701, 700), (700, 701)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 1 for k in range(1, 60)} | {700: 700, 701: 700}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut(rows, least):
    place, gone = {}, {}
    docs = {i: (t or "").split("\n") if t else [] for i, t in sorted(rows)}
    for i, lines in docs.items():
        gone[i] = set()
        for k in range(len(lines)):
            n, words = 0, 0
            while k + n < len(lines) and words < least:
                words += len(lines[k + n].encode().split())
                n += 1
            if words < least:
                continue
            first = place.setdefault(tuple(lines[k : k + n]), (i, k))
            if first != (i, k):
                j, at = first
                while k + n < len(lines) and at + n < len(docs[j]) and docs[j][at + n] == lines[k + n]:
                    n += 1
                gone[i].update(range(k, k + n))
    return {i: (len(x), len(gone[i]), hashlib.sha256("\n".join(line for k, line in enumerate(x) if k not in gone[i]).encode()).hexdigest()) for i, x in docs.items()}


@pytest.mark.parametrize("least", [1, 4, 9])
def test_repeated_line_runs(spark, least):
    rng = random.Random(least)
    vocabulary = ["a b", "c", "d e f", "", "g h", "zz"]
    rows = [(i, "\n".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 14)))) for i in range(40)]
    rows += [(100, None), (101, "")] + [(200 + i, "\n".join(["a b"] * 9)) for i in range(3)]
    got = linededup.line_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == cut(rows, least)


def test_every_later_copy_of_a_line_goes(spark):
    """With the production floor: short lines too, and runs that a place other than the first goes on with."""
    passage, after = " ".join(f"w{k}" for k in range(60)), "one\ntwo words"
    rows = [(1, passage), (2, f"{passage}\n{after}"), (3, f"{passage}\n{after}"), (4, "licensed under x\nown"), (5, "else\nlicensed under x"), (6, "else")]
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.text, r.n_deleted) for r in got} == {1: (passage, 0), 2: (after, 1), 3: ("", 3), 4: ("licensed under x\nown", 0), 5: ("else", 1), 6: ("", 1)}


def test_lines_of_a_table_with_clashing_names(spark):
    rows = [(1, "a b\nc", 1, 2, 3, 4, "x"), (2, "a b\nd", 1, 2, 3, 4, "y"), (None, None, 1, 2, 3, 4, "z")]
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, _d int, u int, d int, N_lines int, _runs string"))
    assert got.columns == ["doc_id", "text", "_d", "u", "d", "_runs", "n_lines", "n_deleted"]
    assert sorted(map(repr, map(tuple, got.collect()))) == ["(1, 'a b\\nc', 1, 2, 3, 'x', 2, 0)", "(2, 'd', 1, 2, 3, 'y', 2, 1)", "(None, None, 1, 2, 3, 'z', 0, 0)"]


def test_lines_of_documents(documents, odd, nothing):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert {r.doc_id: tuple(r)[1:] for r in linededup.line_digests(documents).collect()} == cut(rows, linededup.MIN_WORDS)
    got = linededup.deduplicated(odd)
    assert got.count() == odd.count() and set(odd.columns) < set(got.columns)
    assert {r.doc_id: r.n_deleted for r in got.collect() if r.doc_id}[10] == 0
    assert linededup.line_digests(nothing).count() == 0
