"""Secret scans: three base kinds by pattern, and weak candidates by linking complementary parts.

The base kinds (assign, access, hex) stand by themselves. Weak candidates are access identifiers, secrets and
endpoints that would be noise alone: an interval join within scopes (a stretch of the same text, `reach` characters
either side) reports them only where an identifier and a secret stand together, and an endpoint only with such a pair.

Cases: a null or empty text has no spans; its digest is that of the empty string. Offsets are code points, the end
exclusive. Texts of any length are scanned whole. Repeated rows give repeated results; an empty table an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# The base kinds as their contract states them, in its order.
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 16 or more; shorter runs hold no longer one.
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

# Weak parts, which count only together.
WEAK_ID = re.compile(r"""(?:access[_-]?key(?:[_-]?id)?|client[_-]?id|user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
WEAK_SECRET = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}", re.A)
#: A whole run of the characters of schemes and hosts, read once, and what makes it an endpoint: an address or a port.
ENDPOINT = re.compile(r"""(?<![A-Za-z0-9+.-])([A-Za-z0-9+.-]++):(?:(//[^\x20\x09-\x0D"'<>]++)|\d{2,5})""", re.A)
_LETTER = re.compile(r"[A-Za-z]")
#: Characters either side within which parts belong together.
REACH = 300
#: Bits a character that a weak secret has at least.
BITS = 3.5

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, less those that are too short."""
    found: list[Span] = []
    low = text.encode().lower()
    if any(word in low for word in (b"passw", b"secret", b"token", b"api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return _in_order(found)


def _in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _bits(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


class _Places:
    """Stretches, which may overlap, to be asked whether any comes within reach of another stretch."""

    def __init__(self, stretches: list[tuple[int, int]]):
        stretches = sorted(stretches)
        self.begins = [b for b, _ in stretches]
        #: the furthest end of a stretch and all before it
        self.ends = list(accumulate((e for _, e in stretches), max))

    def near(self, stretch: tuple[int, int], reach: int) -> bool:
        k = bisect_left(self.begins, stretch[1] + reach)
        return k > 0 and self.ends[k - 1] + reach > stretch[0]


def endpoints(text: str) -> list[tuple[int, int]]:
    """Addresses (scheme://...) from the first letter of their run on, and hosts of two labels or more with a port."""
    out = []
    for m in ENDPOINT.finditer(text):
        run = m.group(1)
        if m.group(2):
            letter = _LETTER.search(run)
            if letter:
                out.append((m.start() + letter.start(), m.end()))
            continue
        host = run.rpartition("+")[2]
        _, gap, tail = host.rpartition("..")
        tail = (tail if gap else host).removeprefix(".")
        if "." in tail.strip(".") and not tail.endswith("."):
            out.append((m.end(1) - len(tail), m.end()))
    return out


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak candidates that stand with their complements.

    A weak identifier needs a secret in reach (base or weak); a weak secret needs an identifier in reach (an access
    key or weak) and, unless that is an access key, an endpoint as well; an endpoint needs both. A weak secret lies
    in no base span and no weak identifier.
    """
    if not base and ":" not in text and "=" not in text:
        return []
    strong_ids = [(b, e) for b, e, k in base if k == "access"]
    strong_secrets = [(b, e) for b, e, k in base if k != "access"]
    weak_ids = [(m.start(), m.end()) for m in WEAK_ID.finditer(text)]
    if not strong_ids and not weak_ids:
        return []
    known = _Places(strong_ids + strong_secrets + weak_ids)
    weak_secrets = [
        (m.start(), m.end())
        for m in WEAK_SECRET.finditer(text)
        if not known.near((m.start(), m.end()), 0) and any(map(str.isdigit, m.group())) and any(map(str.isalpha, m.group())) and _bits(m.group()) >= BITS
    ]
    found = endpoints(text)
    at_strong_id, at_weak_id, at_id = _Places(strong_ids), _Places(weak_ids), _Places(strong_ids + weak_ids)
    at_strong_secret, at_secret, at_endpoint = _Places(strong_secrets), _Places(strong_secrets + weak_secrets), _Places(found)
    out: list[Span] = [(*s, "linked_id") for s in weak_ids if at_secret.near(s, reach) and (at_strong_secret.near(s, reach) or at_endpoint.near(s, reach))]
    out += [(*s, "linked_secret") for s in weak_secrets if at_strong_id.near(s, reach) or (at_weak_id.near(s, reach) and at_endpoint.near(s, reach))]
    out += [(*s, "linked_endpoint") for s in found if at_id.near(s, reach) and at_secret.near(s, reach)]
    return out


def spans(text: str, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, in order."""
    base = base_spans(text)
    return base, _in_order(base + linked_spans(text, base, reach))


def written(found: list[Span]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for begin, end, kind in found)


def scanned(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) of every whole text."""
    common.ship(docs.sparkSession)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            both = [spans(t.as_py() or "", reach) for t in batch.column("text")]
            columns = [pa.array([[{"kind": k, "start": b, "end": e} for b, e, k in pair[i]] for pair in both], arrow) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "base", "spans"])

    return common.mapped(common.id_and_text(docs), run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("base", span), T.StructField("spans", span)]))


def scan_digests(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: `scanned` with its spans written out."""
    def line(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:3]]
    return scanned(docs, reach).select("doc_id", *counts, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


def redacted_text(text: str, mark: str = "[SECRET]", reach: int = REACH) -> str:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    out, end = [], 0
    for begin, stop, _ in spans(text, reach)[1]:
        if stop <= end:
            continue
        if begin >= end:
            out += [text[end:begin], mark]
        end = stop
    return "".join(out) + text[end:]


def redacted(docs: DataFrame, mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """The same rows and columns, secrets in `text` replaced by the mark; a null text stays null."""
    common.ship(docs.sparkSession)
    where = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else redacted_text(t, mark, reach) for x in batch.column(where)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == where else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return common.mapped(docs, run, docs.schema)
