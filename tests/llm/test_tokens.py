"""Token counts, codec and packing against the library."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerspark.llm import bpe, packing

NAME = "byte_bpe_50k.json"
VOCABULARY = bpe.Vocabulary(public_tokenizers.path(NAME), public_tokenizers.PATTERN)
LIBRARY = Tokenizer.from_file(public_tokenizers.path(NAME))
COUNTER, CODEC, FAST = bpe.TokenCounter(VOCABULARY, 50), bpe.TokenCodec(VOCABULARY, 50), bpe.FastCodec(VOCABULARY, 50)
PIECES = st.sampled_from([" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "the", " The", "'s", "'", "12", "²", "½", "é", "日本", ".", "<|endoftext|>", "<|endof", "　", "😀", "\u0301", "x" * 40])


def library(text: str) -> bytes:
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(PIECES, max_size=14).map("".join), st.text(max_size=40)))
def test_any_text_as_the_library_has_it(text):
    ids = library(text)
    assert CODEC.encode(text) == ids and FAST.encode(text) == ids
    assert COUNTER.count(text) == len(ids) // 4
    assert CODEC.decode(ids) == LIBRARY.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("run", [" ", "\n", " \n", "\u3000"])
def test_very_long_runs_of_white_space(run):
    for text in (run * (1_500_000 // len(run)), "the" + run * (1_500_000 // len(run)) + "end of  it", "a word " * 200_000 + run * 3):
        assert FAST.encode(text) == library(text)


def test_memory_stays_bounded_and_right():
    for k in range(2_000):
        COUNTER.count(f"text number {k} has w{k}")
    assert len(COUNTER.piece) <= 50 and len(COUNTER.piece.older) <= 50 and len(COUNTER.word) <= 50
    assert COUNTER.count("text number 7 has w7") == len(library("text number 7 has w7")) // 4


def test_counts_of_documents(documents, odd, nothing):
    for table in (documents, odd):
        rows = {(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()}
        want = sorted(map(repr, ((i, len((t or "").encode()), n := len(library(t or "")) // 4, n > 512) for i, t in rows)))
        assert sorted({repr(tuple(r)) for r in bpe.token_counts(table).collect()}) == want
        assert bpe.token_counts(table).count() == table.count()
    assert bpe.token_counts(nothing).count() == 0


def test_codec_of_documents(odd, nothing):
    rows = {(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()}
    want = set()
    for i, t in rows:
        ids = library(t or "")
        decoded = LIBRARY.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        assert decoded == (t or "")
        want.add((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert {tuple(r) for r in bpe.encoded_digests(odd).collect()} == want
    assert {(r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in bpe.encoded(odd).collect()} == want
    assert bpe.encoded_digests(nothing).count() == 0


def check_plan(histogram):
    plan = packing.Plan(histogram)
    windows = defaultdict(list)
    for n in np.flatnonzero(histogram):
        covered = Counter()
        for i, start, size, sequence, offset in plan.places(int(n), np.arange(histogram[n])):
            windows[sequence].append((offset, size))
            covered[i] += size
        assert set(covered.values()) == {int(n)} and len(covered) == histogram[n]
    for pieces in windows.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end == packing.WINDOW or end & (end - 1) == 0
    return plan


@pytest.mark.parametrize("n", [0, 1, 7, 400, 30_000])
def test_plans_fill_windows(n):
    rng = np.random.default_rng(n)
    lengths = np.minimum(packing.WINDOW - 1, 1 + rng.gamma(1.5, 250, n).astype(int))
    plan = check_plan(np.bincount(lengths, minlength=packing.WINDOW))
    if n == 30_000:
        assert plan.packed.sum() > 0.6 * n  # most remainders are placed uncut


def test_one_length_alone():
    for n in (1, 512, 700, 1023):
        check_plan(np.bincount([n] * 999, minlength=packing.WINDOW))


def test_packing_of_documents(documents, odd, nothing):
    for table in (documents, odd):
        pieces, windows = defaultdict(list), defaultdict(list)
        for r in packing.packed(table).collect():
            pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
            windows[r.sequence_id].append((r.offset, r.length))
        want = defaultdict(list)
        for r in table.select("doc_id", "text").collect():
            want[r.doc_id].append(library(r.text or "") + bytes(4))
        assert pieces.keys() == want.keys()
        for i, texts in want.items():
            for ids in set(texts):
                got = sorted(p for p in pieces[i] if p[3] == len(ids) // 4)
                for start, length, crc, _ in got:
                    assert crc in {zlib.crc32(t[4 * start : 4 * (start + length)]) for t in texts}
            assert sum(p[1] for p in pieces[i]) == sum(len(t) // 4 for t in texts)
        for parts in windows.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end == 1024 or end & (end - 1) == 0
    assert packing.packed(nothing).count() == 0


def test_packing_takes_very_long_runs_of_white_space(spark):
    texts = {1: "start" + " " * 1_500_000 + "end", 2: "\n" * 1_500_000, 3: "short"}
    tokens = defaultdict(int)
    for r in packing.packed(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        tokens[r.doc_id] += r.length
    assert tokens == {i: len(library(t)) // 4 + 1 for i, t in texts.items()}
