"""Byte-pair merging with a heap of ranks over a doubly linked symbol list.

``TokenCounter`` only counts (initial symbols minus merges); ``TokenCodec`` emits ids and decodes them.
Both cut a text where the vocabulary's split pattern cuts it, and keep what they found for a piece of text in
a table of bounded size, so that a common word is merged once per worker.

Cases: a null text counts as empty and has no tokens. A special string inside a text is its one id, as the
library has it by default. Texts of any length are handled: a word of n bytes takes O(n log n). Repeated rows give
repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import struct
import sys
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import common

#: Entries that a worker keeps of pieces and of words; beyond that a table starts anew.
MEMO_ENTRIES = 400_000

#: Characters up to which the compiled library may split a text: its split panics on some 1,000,000 white-space characters in a row.
SPLIT_BY_LIBRARY = 500_000

#: Fixed value: how the library writes each byte as a printable character in vocabulary strings.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _byte_characters() -> dict[str, int]:
    """Printable bytes stand for themselves, the others for the characters from U+0100 on, in order."""
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """The symbols, merges and special strings of one tokenizer file (byte-level BPE, .json)."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _byte_characters()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(of[c] for c in s) for s, i in vocab.items()}
        self.symbol = [-1] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.symbol[b[0]] = i
        self.base = max(vocab.values()) + 1
        #: (left, right) as one number -> rank; rank -> id of the merged symbol
        self.rank, self.made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] * self.base + vocab[right]] = rank
            self.made.append(vocab[left + right])
        #: rank of each pair of bytes, -1: none
        self.first = [self.rank.get(left * self.base + right, -1) for left in self.symbol for right in self.symbol]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(pattern)
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merged(self, word: bytes) -> tuple[list[int], int]:
        """The symbols of a word after all merges, -1 where one was absorbed, and how many merges that took.

        The heap holds rank and place of each adjacent pair; an entry whose pair has changed since is stale and skipped.
        """
        n, first, base = len(word), self.first, self.base
        now = [first[left << 8 | right] for left, right in zip(word, word[1:])]  # rank of the pair that starts here
        now.append(-1)
        heap = [rank * n + i for i, rank in enumerate(now) if rank >= 0]
        symbol = [self.symbol[b] for b in word]
        if not heap:
            return symbol, 0
        heapify(heap)
        get, made = self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        done = 0
        while heap:
            rank, i = divmod(heappop(heap), n)
            if now[i] != rank:
                continue
            done += 1
            j, own = after[i], made[rank]
            symbol[i], symbol[j], now[j] = own, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                now[i] = rank = get(own * base + symbol[k], -1)
                if rank >= 0:
                    heappush(heap, rank * n + i)
            else:
                now[i] = -1
            k = before[i]
            if k >= 0:
                now[k] = rank = get(symbol[k] * base + own, -1)
                if rank >= 0:
                    heappush(heap, rank * n + k)
        return symbol, done

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The stretches between special strings, and the ids of those."""
        if self.at_special is None:
            yield text, None
            return
        end = 0
        for m in self.at_special.finditer(text):
            yield text[end : m.start()], None
            yield "", self.special[m.group()]
            end = m.end()
        yield text[end:], None


class _Memo(dict):
    """A table that works out what it lacks. When full it becomes the older table, from which what is still used comes back."""

    def __init__(self, work: Callable, entries: int):
        super().__init__()
        self.work, self.entries, self.older = work, entries // 2, {}

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key, self)
        if value is self:
            value = self.work(key)
        self[key] = value
        return value


def _stands_alone(piece: str) -> bool:
    """Whether the space after this piece surely starts a new word: the piece ends with no white space."""
    return piece != "" and not piece[-1].isspace()


def _spaced_words(piece: str, words: regex.Pattern) -> list[str]:
    """What the split pattern makes of a space and this piece; letters, or those and a mark, are plain to see."""
    if piece.isalpha():
        return [" " + piece]
    if piece[-1] in ".," and piece[:-1].isalpha():
        return [" " + piece[:-1], piece[-1]]
    return words.findall(" " + piece)


class TokenCounter:
    """Counts tokens; no ids are made."""

    #: Makes the sum negative when a piece can't be taken by itself.
    _WHOLE = -(1 << 60)

    def __init__(self, vocabulary: Vocabulary, entries: int = MEMO_ENTRIES):
        self.vocabulary = vocabulary
        self.word = _Memo(self._word, entries)
        self.piece = _Memo(self._piece, entries)

    def _word(self, word: str) -> int:
        symbols = word.encode()
        return len(symbols) - self.vocabulary.merged(symbols)[1]

    def _words(self, text: str) -> int:
        return sum(map(self.word.__getitem__, self.vocabulary.words.findall(text)))

    def _piece(self, piece: str) -> int:
        if not _stands_alone(piece):
            return self._WHOLE
        return sum(map(self.word.__getitem__, _spaced_words(piece, self.vocabulary.words)))

    def _segment(self, text: str) -> int:
        first, *rest = text.split(" ")
        if rest and _stands_alone(first):
            n = sum(map(self.piece.__getitem__, rest))
            if n >= 0:
                return n + self._words(first)
        return self._words(text)

    def count(self, text: str) -> int:
        return sum(1 if special is not None else self._segment(s) for s, special in self.vocabulary.segments(text))


class TokenCodec:
    """Encodes to ids, held as little-endian unsigned 32-bit integers, and decodes those."""

    def __init__(self, vocabulary: Vocabulary, entries: int = MEMO_ENTRIES):
        self.vocabulary = vocabulary
        self.word = _Memo(self._word, entries)
        self.piece = _Memo(self._piece, entries)
        self.strings = [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of) + 1)]

    def _word(self, word: str) -> bytes:
        ids = [i for i in self.vocabulary.merged(word.encode())[0] if i >= 0]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.word.__getitem__, self.vocabulary.words.findall(text)))

    def _piece(self, piece: str) -> bytes | None:
        if not _stands_alone(piece):
            return None
        return b"".join(map(self.word.__getitem__, _spaced_words(piece, self.vocabulary.words)))

    def _segment(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if rest and _stands_alone(first):
            found = list(map(self.piece.__getitem__, rest))
            if None not in found:
                return self._words(first) + b"".join(found)
        return self._words(text)

    def encode(self, text: str) -> bytes:
        return b"".join(self._segment(s) if special is None else special.to_bytes(4, "little") for s, special in self.vocabulary.segments(text))

    def decode(self, ids: bytes) -> str:
        """Concatenate the vocabulary's strings; bytes that form no character become U+FFFD."""
        if sys.byteorder != "little":
            raise NotImplementedError("ids are read in place on little-endian machines only")
        return b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


class FastCodec(TokenCodec):
    """The same ids with words merged by a compiled library: for operators that need ids and have another method."""

    def __init__(self, vocabulary: Vocabulary, entries: int = MEMO_ENTRIES):
        import tiktoken

        super().__init__(vocabulary, entries)
        # ranks of whole strings stand for ranks of pairs: true of vocabularies whose ids follow their merges
        if any(i >= j for i, j in zip(vocabulary.made, vocabulary.made[1:])):
            raise ValueError("this vocabulary's ids don't follow the order of its merges")
        ranks = {b: i for i, b in vocabulary.bytes_of.items() if i not in vocabulary.special.values()}
        self.library = tiktoken.Encoding("words", pat_str=vocabulary.words.pattern, mergeable_ranks=ranks, special_tokens={})

    def _word(self, word: str) -> bytes:
        ids = self.library._encode_single_piece(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _words(self, text: str) -> bytes:
        if len(text) > SPLIT_BY_LIBRARY:
            return b"".join(map(self._word, self.vocabulary.words.findall(text)))
        ids = self.library.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes | None:
        return self._words(" " + piece) if _stands_alone(piece) else None


def on_worker(kind: type, name: str, entries: int = MEMO_ENTRIES):
    """The worker's own counter or codec of a public vocabulary; it stays for the worker's later tasks."""

    def make():
        import public_tokenizers

        return kind(Vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN), entries)

    return common.worker_cache((kind.__name__, name, entries), make)


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    """The texts one by one, null as empty: a batch isn't held twice."""
    return (x.as_py() or "" for x in batch.column("text"))


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens) of every whole text.

    Null texts: 0 bytes, 0 tokens, not over the limit. A null doc_id stays null.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        counter = on_worker(TokenCounter, vocabulary)
        for batch in batches:
            n = pa.array(map(counter.count, _texts(batch)), pa.int64())
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(batch.column("text")), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.mapped(common.id_and_text(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", cached=True)


def encoded(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded text of every whole text.

    Null texts: no ids, an empty decoded text. The decoded text of a well-formed text is that text.
    """
    common.ship(docs.sparkSession)

    def run(batches):
        codec = on_worker(TokenCodec, vocabulary)
        for batch in batches:
            for piece in _slices(batch):
                ids = [codec.encode(t) for t in _texts(piece)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.string())], ["doc_id", "n_tokens", "ids", "decoded"]
                )

    return common.mapped(common.id_and_text(docs), run, "doc_id long, n_tokens long, ids binary, decoded string", cached=True)


def encoded_digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: `encoded` with its ids and decoded text digested on the spot."""
    common.ship(docs.sparkSession)

    def run(batches):
        codec = on_worker(TokenCodec, vocabulary)
        for batch in batches:
            rows = []
            for text in _texts(batch):
                ids = codec.encode(text)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()))
            n, of_ids, of_text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.mapped(common.id_and_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", cached=True)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)
