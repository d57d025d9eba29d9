"""Sets of word shingles as sorted 64-bit hashes, made for many texts at once without an object for each word.

Words are what ASCII white space leaves of a text whose A-Z are lower-cased. A word's hash folds it eight bytes at a
time, its length first, so that short words can't collide; a shingle's mixes those of its words in order. Two different
shingles have equal hashes once in some 10^19 comparisons.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words of a shingle.
WORDS = 5
#: Bytes of text that are worked on at once; a longer text is cut at white space.
STRETCH = 2_000_000
#: Bytes of a word up to which words are folded together; longer ones are hashed one by one.
FOLDED = 128

_STEP = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: What to keep of eight bytes of which a word has so many.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of these bytes its begin and its hash."""
    padded = b" " + data + b" " * 9
    byte = np.frombuffer(padded, np.uint8)
    turns = np.flatnonzero(np.diff(_IS_SPACE[byte]))  # the byte before each begin, then the last of each word
    begins, ends = turns[0::2] + 1, turns[1::2] + 1
    sizes = ends - begins
    eight = np.ndarray(len(padded) - 8, np.uint64, padded, strides=(1,))
    h = sizes.astype(np.uint64) * _STEP
    at = np.arange(len(begins))
    for done in range(0, FOLDED, 8):
        if not len(at):
            break
        h[at] = _mixed(h[at] ^ (eight[begins[at] + done] & _KEEP[np.minimum(sizes[at] - done, 8)]))
        at = at[sizes[at] > done + 8]
    for k in at.tolist():
        h[k] = xxhash.xxh3_64_intdigest(padded[begins[k] : ends[k]])
    return begins - 1, h


def _stretches(data: bytes):
    """Begins and ends of stretches that end at white space."""
    begin = 0
    while len(data) - begin > STRETCH:
        near = np.flatnonzero(_IS_SPACE[np.frombuffer(data, np.uint8, STRETCH, begin)])
        if len(near):
            end = begin + int(near[-1]) + 1
        else:  # a word longer than a stretch
            end = begin + STRETCH
            while end < len(data) and not _IS_SPACE[data[end]]:
                end += 1
        yield begin, end
        begin = end
    yield begin, len(data)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of these texts, and how many each text has."""
    data = b"\n".join(texts).lower()
    begins, hashes = [], []
    for b, e in _stretches(data):
        at, h = _hashed(data[b:e])
        begins.append(at + b)
        hashes.append(h)
    ends = np.cumsum([len(t) + 1 for t in texts])
    places = np.searchsorted(np.concatenate(begins), ends)
    return np.concatenate(hashes), np.diff(places, prepend=0)


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    fresh = np.empty(len(h), bool)
    fresh[:1] = True
    np.not_equal(h[1:], h[:-1], out=fresh[1:])
    return h[fresh]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Of each text its distinct shingles, as sorted 64-bit hashes. A text of fewer words has one: all of them."""
    if not texts:
        return []
    flat, sizes = word_hashes([(t or "").encode() for t in texts])
    rolled = flat.copy()
    for k in range(1, words):
        end = max(0, len(flat) - k)
        rolled[:end] = rolled[:end] * _STEP + flat[k:]
    rolled = _mixed(rolled)
    out, begin = [], 0
    for n in sizes.tolist():
        if n >= words:
            out.append(_distinct(rolled[begin : begin + n - words + 1]))
        elif n:
            h = np.array([n], np.uint64)
            for k in range(begin, begin + n):
                h = h * _STEP + flat[k]
            out.append(_mixed(h + np.uint64(1)))
        else:
            out.append(np.empty(0, np.uint64))
        begin += n
    return out


def slices(batch: pa.RecordBatch, rows: int = 500, column: str = "text"):
    """A batch in slices of few rows and, but for rows that are longer by themselves, of few bytes."""
    sizes = np.cumsum(pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = min(begin + rows, max(begin + 1, int(np.searchsorted(sizes, before + STRETCH, side="right"))))
        yield batch.slice(begin, end - begin)
        begin = end
