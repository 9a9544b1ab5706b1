"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is one sequence of bytes. It is read in windows: :data:`CORE` bytes whose positions are labelled, with :data:`CONTEXT` bytes of the
same text before and behind, from which the states come; white space and words are no borders. Beyond the ends of a text stands a symbol of its own. Every
byte position gets a distribution over languages, and a document's probabilities are the mean of those of
all its positions.

Training is backpropagation through time on a bounded sample: about ``max_docs`` labelled documents, chosen by a hash of
their id, and of each up to :data:`PIECES` runs of characters at hashed places, at most ``max_pieces`` in all.
Half of the steps read windows from inside of texts, half whole short texts. Positions weigh inversely to their language's share of the sample.

Defined cases: null texts and texts without a letter are ``und`` with score 0. Without labelled
documents nothing is learned and every text is ``und``. Ties go to the first language in byte order. Repeated rows are predicted alike. Texts
of any length are read whole, a bounded number of windows at a time. Other columns are carried by :func:`predicted`; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import arrow_map

UNKNOWN = "und"
#: States of a direction; the symbol beyond a text's ends; bytes labelled and read around them in a window; windows' cores are padded to a multiple of GRID.
HIDDEN, EDGE, CORE, CONTEXT, GRID = 8, 256, 240, 16, 16
#: The sample's bounds: documents, pieces of a document, characters of a piece, pieces.
MAX_DOCS, PIECES, PIECE_CHARS, MAX_PIECES = 4000, 8, 160, 16_000
STEPS, BATCH, RATE = 300, 256, 0.02
#: Labelled bytes of a window in training.
TRAINED_CORE = 112
#: Windows in one call of the network; bytes of texts that are read together.
WIDE, TOGETHER = 1024, 1 << 20
_letter = regex.compile(r"\p{L}")


@dataclass
class Direction:
    """One gated recurrent layer: x maps symbols to the inputs of update, reset and new state."""

    x: np.ndarray  # (257, 3 * HIDDEN)
    u: np.ndarray  # (HIDDEN, 3 * HIDDEN)


def windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, owners): windows of the texts in blocks of equal length, and the index of each one's text."""
    if not texts:
        return
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = -(-lengths // CORE)
    owners = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin, end = (np.cumsum(lengths) - lengths)[owners], np.cumsum(lengths)[owners]
    start = begin + nth * CORE
    cores = -(-np.minimum(CORE, end - start) // GRID) * GRID
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16)
    for core in np.unique(cores):
        of_core = np.flatnonzero(cores == core)
        for at in range(0, len(of_core), WIDE):
            some = of_core[at : at + WIDE]
            place = start[some][:, None] + np.arange(-CONTEXT, core + CONTEXT)
            inside = (place >= begin[some][:, None]) & (place < end[some][:, None])
            yield np.where(inside, flat[np.clip(place, 0, len(flat) - 1)], np.int16(EDGE)), owners[some]


class Network:
    def __init__(self, langs: list[str], seed: int = 0):
        r = np.random.default_rng(seed)
        make = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
        self.langs = langs
        self.ways = [Direction(make(257, 3 * HIDDEN), make(HIDDEN, 3 * HIDDEN)) for _ in range(2)]
        self.out, self.bias = make(2 * HIDDEN, len(langs)), np.zeros(len(langs), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [p for w in self.ways for p in (w.x, w.u)] + [self.out, self.bias]

    def _run(self, way: Direction, symbols: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (time, batch, HIDDEN) of symbols (batch, time); ``keep`` what backpropagation needs. A gate is (1 + tanh(v / 2)) / 2."""
        n, steps, half = *symbols.shape, np.float32(0.5)
        x_gates, u_gates = way.x[:, : 2 * HIDDEN] * half, way.u[:, : 2 * HIDDEN] * half
        x_new, u_new = (np.ascontiguousarray(m[:, 2 * HIDDEN :]) for m in (way.x, way.u))
        h, states, tape = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), []
        columns = np.ascontiguousarray(symbols.T)
        for t in range(steps):
            gates = h @ u_gates
            gates += x_gates[columns[t]]
            np.tanh(gates, out=gates)
            gates *= half
            gates += half
            z, r, an = gates[:, :HIDDEN], gates[:, HIDDEN:], h @ u_new
            new = r * an
            new += x_new[columns[t]]
            np.tanh(new, out=new)
            if keep:
                tape.append((h, z, r, an, new))
            h = h - new
            h *= z
            h += new
            states[t] = h
        return states, tape

    def _positions(self, symbols: np.ndarray, keep: bool = False):
        """Probabilities (core, batch, languages) of the labelled positions of windows (batch, time)."""
        ahead, tape_a = self._run(self.ways[0], symbols, keep)
        back, tape_b = self._run(self.ways[1], symbols[:, ::-1], keep)
        both = np.concatenate([ahead, back[::-1]], 2)[CONTEXT:-CONTEXT]
        e = both @ self.out + self.bias
        e = np.exp(e - e.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True), both, tape_a, tape_b

    def _back(self, way: Direction, symbols: np.ndarray, tape: list, grads: np.ndarray) -> list[np.ndarray]:
        """Gradients of x and u; grads (time, batch, HIDDEN) are those of the states."""
        dx, du, dh = np.zeros_like(way.x), np.zeros_like(way.u), np.zeros_like(tape[0][0])
        for t in range(len(tape) - 1, -1, -1):
            h, z, r, an, new = tape[t]
            dh = dh + grads[t]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r], 1)
            np.add.at(dx, symbols[:, t], np.concatenate([dz, dr, dn], 1))
            du += h.T @ da
            dh = dh * z + da @ way.u.T
        return [dx, du]

    def gradients(self, symbols: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of all parameters. Positions beyond a text's ends do not count."""
        p, both, tape_a, tape_b = self._positions(symbols, True)
        counts = (symbols[:, CONTEXT:-CONTEXT] != EDGE).T * weights
        n, row = counts.sum(), np.arange(len(labels))
        loss = float(-(np.log(p[:, row, labels] + 1e-9) * counts).sum() / n)
        d = p.copy()
        d[:, row, labels] -= 1
        d = (d * (counts / n)[:, :, None]).astype(np.float32)
        flat = d.reshape(-1, d.shape[2])
        none = np.zeros((CONTEXT, *d.shape[1:2], 2 * HIDDEN), np.float32)
        dboth = np.concatenate([none, d @ self.out.T, none])
        ga = self._back(self.ways[0], symbols, tape_a, dboth[:, :, :HIDDEN])
        gb = self._back(self.ways[1], symbols[:, ::-1], tape_b, dboth[::-1, :, HIDDEN:])
        return loss, [*ga, *gb, both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)]

    def _states(self, way: Direction, columns: np.ndarray) -> np.ndarray:
        """:meth:`_run` for reading alone: states (time, HIDDEN, batch) of columns (time, batch), with whole rows of windows in each operation."""
        half, (steps, n) = np.float32(0.5), columns.shape
        x, u = np.ascontiguousarray(way.x.T), np.ascontiguousarray(way.u.T)
        x[: 2 * HIDDEN] *= half
        u[: 2 * HIDDEN] *= half
        g, a, states = np.empty((3 * HIDDEN, n), np.float32), np.empty((3 * HIDDEN, n), np.float32), np.zeros((steps + 1, HIDDEN, n), np.float32)
        gates, z, r, new = g[: 2 * HIDDEN], g[:HIDDEN], g[HIDDEN : 2 * HIDDEN], a[2 * HIDDEN :]
        for t in range(steps):
            np.take(x, columns[t], axis=1, out=g, mode="clip")
            np.matmul(u, states[t], out=a)
            gates += a[: 2 * HIDDEN]
            np.tanh(gates, out=gates)
            gates *= half
            gates += half
            new *= r
            new += g[2 * HIDDEN :]
            np.tanh(new, out=new)
            h = np.subtract(states[t], new, out=states[t + 1])
            h *= z
            h += new
        return states[1:]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the sum over a text's positions of their probabilities."""
        out = np.zeros((len(texts), len(self.langs)))
        ahead, back = (np.ascontiguousarray(part.T) for part in (self.out[:HIDDEN], self.out[HIDDEN:]))
        for symbols, owners in windows(texts):
            columns = np.ascontiguousarray(symbols.T).astype(np.intp)
            e = np.matmul(ahead, self._states(self.ways[0], columns)[CONTEXT:-CONTEXT])  # (core, languages, windows)
            e += np.matmul(back, self._states(self.ways[1], columns[::-1])[::-1][CONTEXT:-CONTEXT])
            e += self.bias[:, None]
            e -= e.max(1, keepdims=True)
            np.exp(e, out=e)
            e *= (columns[CONTEXT:-CONTEXT] != EDGE)[:, None] / e.sum(1, keepdims=True)
            np.add.at(out, owners, e.sum(0, dtype=np.float64).T)
        return out


def framed(text: bytes) -> np.ndarray:
    """A short text as a window: ends, padding and all."""
    return next(windows([text]))[0][0]


def fitted(pieces: list[tuple[str, bytes]], steps: int = STEPS) -> Network | None:
    """A network trained on (language, run of a text's bytes)."""
    pieces = [(lang, raw) for lang, raw in pieces if raw.strip()]
    if not pieces:
        return None
    langs = sorted({lang for lang, _ in pieces})
    net, r = Network(langs), np.random.default_rng(1)
    labels = np.array([langs.index(lang) for lang, _ in pieces])
    weights = (len(labels) / len(langs) / np.bincount(labels, minlength=len(langs)))[labels].astype(np.float32)
    width = TRAINED_CORE + 2 * CONTEXT
    long = np.array([i for i, (_, raw) in enumerate(pieces) if len(raw) >= width])
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        if step % 2 and len(long):
            pick = r.choice(long, BATCH)
            block = np.stack([np.frombuffer(pieces[i][1][:width], np.uint8) for i in pick]).astype(np.int64)
        else:
            pick, most = r.choice(len(pieces), BATCH), int(r.choice([GRID, 2 * GRID, 4 * GRID]))
            begin = r.integers(0, width, BATCH)
            some = [pieces[i][1][b % max(1, len(pieces[i][1]) - most) :][:most] for i, b in zip(pick, begin)]
            rows = [framed(x + b" " * (most - len(x))) for x in some]
            block = np.stack(rows)
        _, grads = net.gradients(block, labels[pick], weights[pick])
        rate = RATE * (1 - 0.9 * step / steps)
        for p, g, (m, v) in zip(net.parameters(), grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the ids that is never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def trained(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS, max_pieces: int = MAX_PIECES) -> Network | None:
    """Learn from the texts and languages of labelled documents that are not held out."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where(~held_out("i") & F.col("l").isNotNull() & F.col("t").isNotNull())
    total = rows.select("i").count()
    if total > max_docs:
        rows = rows.where(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(1_000_000)) < int(1_000_000 * max_docs / total) + 1)
    free = F.greatest(F.length("t") - PIECE_CHARS, F.lit(0)) + 1
    place = lambda k: F.pmod(F.xxhash64(F.col("i").cast("string"), k), free).cast("int")
    begins = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), place))
    cut = rows.select("l", F.explode(F.transform(begins, lambda b: F.substring("t", b + 1, F.lit(PIECE_CHARS)))).alias("w")).where("trim(w) <> ''")
    # the order is total, so the same rows are taken every time
    taken = cut.orderBy(F.xxhash64("w", "l"), "w", "l").limit(max_pieces).collect()
    return fitted([(r["l"], r["w"].encode()) for r in taken])


def predict(net: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text; a bounded number of bytes goes through the network together, but for a text that is longer alone."""
    out, waiting, size = [(UNKNOWN, 0.0)] * len(texts), [], 0

    def settle() -> None:
        for (i, raw), total in zip(waiting, net.scores([raw for _, raw in waiting])):
            p = total / len(raw)
            best = int(p.argmax())
            out[i] = net.langs[best], float(min(1.0, p[best]))
        waiting.clear()

    for i, text in enumerate(texts):
        if text and _letter.search(text):
            raw = text.encode()
            waiting.append((i, raw))
            size += len(raw)
            if size >= TOGETHER:
                settle()
                size = 0
    settle()
    return out


def predicted(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred string and score double. No shuffle; the text is the only input."""
    docs = docs.drop("lang_pred", "score")
    if net is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict(sent.value, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema.names)

    return arrow_map(docs, run, schema)
