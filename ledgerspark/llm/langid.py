"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time, on windows of a bounded sample of labelled
texts. It labels every byte of a text with probabilities of the languages; a text's probabilities are the means over
all its bytes. Long texts are run as windows side by side, each position with what stands before and after it there.

Cases: a null text, or one without a letter, is `und` with score 0. Texts of any length are read whole, in bounded
memory. Equal texts get equal answers; ties go to the language that sorts first. With no labelled row to learn from,
everything is `und`. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    hidden: int = 6  # units in each direction
    window: int = 96  # bytes that are run through as one sequence
    lanes: int = 4096  # windows side by side
    sample_rows: int = 3000  # labelled rows that are learned from, at most
    sample_windows: int = 6  # of each, of `window` characters from anywhere in the whole text
    steps: int = 200
    batch: int = 128  # windows a step
    rate: float = 0.02
    seed: int = 7


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _tanh_half(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Parameters of both directions and of the output layer; units are rows, lanes are columns."""

    def __init__(self, languages: list[str], settings: Settings, weights: dict[str, np.ndarray] | None = None):
        self.languages, self.settings = languages, settings
        h, c, rng = settings.hidden, len(languages), np.random.default_rng(settings.seed)
        if weights is None:
            weights = {}
            for d in "fb":
                weights[f"E{d}"] = rng.normal(0, 0.3, (3 * h, 256)).astype("f4")  # what a byte adds to update, reset, candidate
                weights[f"U{d}"] = rng.normal(0, h**-0.5, (3 * h, h)).astype("f4")
                weights[f"c{d}"] = np.zeros((3 * h, 1), "f4")
                weights[f"O{d}"] = rng.normal(0, 0.3, (c, h)).astype("f4")
            weights["o"] = np.zeros((c, 1), "f4")
        self.weights = weights

    def _run(self, d: str, codes: np.ndarray, keep: bool = False):
        """States after each position, codes being time by lanes; what backpropagation needs with them."""
        w, h = self.weights, self.settings.hidden
        table, u, c = np.ascontiguousarray(w[f"E{d}"]), w[f"U{d}"], w[f"c{d}"]
        time, lanes = codes.shape
        states = np.empty((time, h, lanes), "f4")
        gates = np.empty((time, 3 * h, lanes), "f4") if keep else None
        inner = np.empty((time, h, lanes), "f4") if keep else None
        state, x, s = np.zeros((h, lanes), "f4"), np.empty((3 * h, lanes), "f4"), np.empty((3 * h, lanes), "f4")
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            np.take(table, codes[t], axis=1, out=x, mode="clip")
            np.matmul(u, state, out=s)
            s += c
            x[: 2 * h] += s[: 2 * h]
            _tanh_half(x[: 2 * h])
            if keep:
                inner[t] = s[2 * h :]
            s[2 * h :] *= x[h : 2 * h]
            x[2 * h :] += s[2 * h :]
            np.tanh(x[2 * h :], out=x[2 * h :])
            new = states[t]
            np.subtract(state, x[2 * h :], out=new)
            new *= x[:h]
            new += x[2 * h :]
            if keep:
                gates[t] = x
            state = new
        return states, gates, inner

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Languages by time by lanes: a label for every position."""
        w = self.weights
        time, lanes = codes.shape
        p = np.empty((len(self.languages), time, lanes), "f4")
        f, b = self._run("f", codes)[0], self._run("b", codes)[0]
        for t in range(time):
            z = w["Of"] @ f[t]
            z += w["Ob"] @ b[t]
            z += w["o"]
            z -= z.max(axis=0)
            np.exp(z, out=z)
            z /= z.sum(axis=0)
            p[:, t] = z
        return p

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions, by backpropagation through time."""
        w, h = self.weights, self.settings.hidden
        time, lanes = codes.shape
        kept = {d: self._run(d, codes, keep=True) for d in "fb"}
        z = np.einsum("ch,thl->tcl", w["Of"], kept["f"][0]) + np.einsum("ch,thl->tcl", w["Ob"], kept["b"][0]) + w["o"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[:, target, np.arange(lanes)] -= 1
        z /= time * lanes
        out = {"o": z.sum(axis=(0, 2))[:, None]}
        for d in "fb":
            states, gates, inner = kept[d]
            out[f"O{d}"] = np.einsum("tcl,thl->ch", z, states)
            into = np.einsum("ch,tcl->thl", w[f"O{d}"], z)
            u, back = w[f"U{d}"], np.zeros((h, lanes), "f4")
            g_u, g_in = np.zeros_like(u), np.empty((time, 3 * h, lanes), "f4")
            g_c = np.zeros_like(w[f"c{d}"])
            order = range(time - 1, -1, -1) if d == "f" else range(time)
            for t in order:
                before = t - 1 if d == "f" else t + 1
                old = states[before] if 0 <= before < time else np.zeros((h, lanes), "f4")
                update, reset, candidate = gates[t, :h], gates[t, h : 2 * h], gates[t, 2 * h :]
                g = into[t] + back
                g_candidate = g * (1 - update) * (1 - candidate * candidate)
                g_gate = np.concatenate([g * (old - candidate) * update * (1 - update), g_candidate * inner[t] * reset * (1 - reset)])
                through = np.concatenate([g_gate, g_candidate * reset])
                g_u += through @ old.T
                g_c += through.sum(axis=1, keepdims=True)
                back = g * update + u.T @ through
                g_in[t, : 2 * h], g_in[t, 2 * h :] = g_gate, g_candidate
            flat = codes.ravel()
            g_e = np.empty_like(w[f"E{d}"])
            for k in range(3 * h):
                g_e[k] = np.bincount(flat, g_in[:, k].ravel(), 256)
            out |= {f"E{d}": g_e, f"U{d}": g_u, f"c{d}": g_c}
        return out


def trained(texts: list[bytes], labels: list[str], settings: Settings = Settings()) -> Network:
    """A network that has learned these texts; languages are drawn equally often whatever their share."""
    languages = sorted(set(labels))
    net, rng = Network(languages, settings), np.random.default_rng(settings.seed)
    by = [[t for t, x in zip(texts, labels) if x == language and t.strip()] for language in languages]
    languages_with = [k for k, ts in enumerate(by) if ts]
    if not languages_with:
        return net
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, settings.steps + 1):
        target = rng.choice(languages_with, settings.batch)
        codes = np.full((settings.window, settings.batch), 32, np.intp)
        for lane, k in enumerate(target):
            text = by[k][rng.integers(len(by[k]))]
            begin = rng.integers(max(1, len(text) - settings.window + 1))
            cut = np.frombuffer(text[begin : begin + settings.window], np.uint8)
            codes[: len(cut), lane] = cut
        rate = settings.rate * min(1.0, 2 * (1 - step / (settings.steps + 1)))
        for k, g in net.gradients(codes, target).items():
            np.clip(g, -0.5, 0.5, out=g)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.weights[k] = (net.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype("f4")
    return net


_LETTERLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    m = _LETTERLIKE.search(text)
    return m is not None and (m.group().isalpha() or any(map(str.isalpha, text)))


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probabilities of each text, by language: the means over all its bytes (texts aren't empty).

    A text's last window reaches back over bytes that the window before it has labelled; those count once.
    A text shorter than a window is followed by spaces, which don't count.
    """
    window, lanes = net.settings.window, net.settings.lanes
    sums, sizes = np.zeros((len(texts), len(net.languages))), np.array([len(t) for t in texts])
    waiting: list[tuple[int, bytes, int, int]] = []  # text, bytes, first and last position that count

    def flush() -> None:
        codes = np.frombuffer(b"".join(w[1] for w in waiting), np.uint8).reshape(len(waiting), window).T.astype(np.intp)
        p = net.probabilities(np.ascontiguousarray(codes))
        owner, low, high = (np.array([w[k] for w in waiting]) for k in (0, 2, 3))
        at = np.arange(window)[:, None]
        partial = (low > 0) | (high < window)
        total = p.sum(axis=1, dtype="f8")
        if partial.any():
            counts = (at >= low[partial]) & (at < high[partial])
            total[:, partial] = (p[:, :, partial] * counts).sum(axis=1, dtype="f8")
        for c in range(len(net.languages)):
            sums[:, c] += np.bincount(owner, total[c], len(texts))
        waiting.clear()

    for k, text in enumerate(texts):
        n = len(text)
        if n < window:
            waiting.append((k, text.ljust(window), 0, n))
        for begin in range(0, n - window + 1, window):
            waiting.append((k, text[begin : begin + window], 0, window))
            if len(waiting) == lanes:
                flush()
        if n > window and n % window:
            waiting.append((k, text[n - window :], window - n % window, window))
        if len(waiting) >= lanes:
            flush()
    if waiting:
        flush()
    return sums / np.maximum(sizes, 1)[:, None]


def training_sample(docs: DataFrame, settings: Settings) -> tuple[list[bytes], list[str]]:
    """Windows from all over the whole texts of at most `sample_rows` labelled rows, those whose ids hash lowest."""
    rows_with_label = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    places = F.greatest(F.length("text") - settings.window + 1, F.lit(1))
    cut = F.transform(F.sequence(F.lit(1), F.lit(settings.sample_windows)), lambda k: F.col("text").substr((F.pmod(F.xxhash64("doc_id", k), places) + 1).cast("int"), F.lit(settings.window)))
    rows = common.hashed_sample(rows_with_label.select("doc_id", "lang", F.array_distinct(cut).alias("cuts")), ["doc_id", "lang"], settings.sample_rows).collect()
    cuts = sorted((r.lang, c.encode()) for r in rows for c in r.cuts)
    return [c for _, c in cuts], [lang for lang, _ in cuts]


def fitted(docs: DataFrame, settings: Settings = Settings()) -> Network | None:
    texts, labels = training_sample(docs, settings)
    return trained(texts, labels, settings) if texts else None


def labelled(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each whole text; the prediction sees the text alone."""
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    lettered = [i for i, t in enumerate(texts) if net is not None and t and has_letter(t)]
    if lettered:
        p = pooled(net, [texts[i].encode() for i in lettered])
        for i, best, value in zip(lettered, p.argmax(axis=1), p.max(axis=1)):
            lang[i], score[i] = net.languages[best], min(1.0, float(value))
    return lang, score


def _parts(batches, rows: int = 400):
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    common.ship(docs.sparkSession)

    def run(batches):
        for part in _parts(batches):
            lang, score = labelled(net, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return common.mapped(common.id_and_text(docs), run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, net: Network | None, least_score: float) -> DataFrame:
    """The rows whose text gets a language with this score at least; all columns."""
    common.ship(docs.sparkSession)
    where = docs.columns.index("text")

    def run(batches):
        for part in _parts(batches):
            lang, score = labelled(net, part.column(where).to_pylist())
            yield part.filter(pa.array([x != UNKNOWN and s >= least_score for x, s in zip(lang, score)], pa.bool_()))

    return common.mapped(docs, run, docs.schema)


def identified(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that aren't held out, said of all rows."""
    found = predicted(docs, fitted(docs, settings))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
