"""Quality classifier (operator 2): gated attention over the passages of a document, learnt from document labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import adam, cut, label_rows, labelled_texts, mix, remainder, sigmoid, text_batches
from .words import DIGIT, LETTER, SPACE, SYMBOL, UPPER, Hasher, Texts

#: Words of a passage.
PASSAGE = 50
#: At most so many labelled documents are learnt from, each with all its passages; no further one is taken once they
#: have so many bytes of text.
SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
SHAPES, BAG = 64, 64
COUNTS = 8
DIM = COUNTS + 3 + SHAPES + BAG
HIDDEN, GATE = 20, 10


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, text of each row): passages as shares of character kinds, repetition, hashed shapes and words.

    An empty text is one row of zeros."""
    t = Texts(texts)
    n, own, kind = t.count, t.own, t.kind
    at = np.arange(len(own)) - t.first[own]
    per = np.maximum(1, -(-n // PASSAGE))
    base = np.cumsum(per) - per
    of = base[own] + at // PASSAGE
    total = int(per.sum())
    letter, size = (kind & 7) == LETTER, t.end - t.start
    alpha, upper = t.per_word(letter), t.per_word(kind == LETTER + UPPER)
    digit, symbol = t.per_word(kind == DIGIT), t.per_word(kind == SYMBOL)
    counts = [size, alpha, upper, digit, symbol, size - alpha - digit - symbol, alpha == 0, (alpha > 1) & (upper == alpha)]
    x = np.zeros((total, DIM), np.float32)
    words = np.bincount(of, minlength=total)
    for k, c in enumerate(counts):
        x[:, k] = np.bincount(of, c, minlength=total)
    share = np.maximum(words, 1)[:, None]
    x[:, 1:6] /= np.maximum(x[:, :1], 1)
    x[:, 6:8] /= share
    x[:, 0] = x[:, 0] / share[:, 0] / 8
    h = t.hasher()(t.start, t.end)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    x[:, COUNTS] = np.bincount(of[same], minlength=total) / share[:, 0]
    order = np.argsort(h ^ mix(of))
    g, o = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    x[:, COUNTS + 1] = np.bincount(o[new], minlength=total) / share[:, 0]
    x[:, COUNTS + 2] = np.minimum(words / PASSAGE, 1)
    # a word's shape: letters as X or x, digits as 9, other characters as they are, runs as one
    like = np.where(kind == LETTER + UPPER, 88, np.where(letter, 120, np.where(kind == DIGIT, 57, np.where(kind == SPACE, 32, t.x))))
    keep = np.diff(like, prepend=0) != 0
    place = np.concatenate(([0], np.cumsum(keep)))
    shape = Hasher(like[keep])(place[t.start], place[t.end])
    for first, width, code in ((COUNTS + 3, SHAPES, shape), (COUNTS + 3 + SHAPES, BAG, h)):
        bucket = (mix(code) % np.uint64(width)).astype(np.int64)
        x[:, first : first + width] = np.sqrt(np.bincount(of * width + bucket, minlength=total * width).reshape(total, width) / share)
    return x, np.repeat(np.arange(len(n)), per)


class Attention:
    """h = tanh(x W + b); a = softmax over a document of w . (tanh(h V) * sigmoid(h U)); score = sigmoid(sum(a h) . c + d)."""

    SHAPE = {"W": (DIM, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}

    def __init__(self, mean, scale, p):
        self.mean, self.scale, self.p = mean, scale, p

    @classmethod
    def parts(cls, p: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in cls.SHAPE.items():
            n = int(np.prod(shape))
            out[name] = p[at : at + n].reshape(shape)
            at += n
        return out

    @staticmethod
    def forward(q, x, first):
        """first: where each document's rows begin (ascending, each has a row)."""
        size = np.diff(np.append(first, len(x)))
        h = np.tanh(x @ q["W"] + q["b"])
        t, g = np.tanh(h @ q["V"]), sigmoid(h @ q["U"])
        e = (t * g) @ q["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
        a = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(a[:, None] * h, first)
        return h, t, g, a, z, sigmoid(z @ q["c"] + q["d"]), size

    @classmethod
    def train(cls, x: np.ndarray, own: np.ndarray, y: np.ndarray, steps: int = 600, batch: int = 128) -> Attention:
        mean = x.mean(0, dtype=float)
        square = sum(((x[k : k + 8192] - mean) ** 2).sum(0) for k in range(0, len(x), 8192))
        scale = np.sqrt(square / len(x)) + 0.05
        first = np.searchsorted(own, np.arange(len(y)))
        size = np.diff(np.append(first, len(x)))
        rng = np.random.default_rng(3)
        start = np.concatenate([(rng.standard_normal(s) / np.sqrt(s[0]) * (len(s) > 1 or s[0] > 1)).ravel() for s in cls.SHAPE.values()])

        def grad(p, _, rng):
            q = cls.parts(p)
            docs = rng.integers(0, len(y), batch)
            rows = np.concatenate([np.arange(first[d], first[d] + size[d]) for d in docs])
            f = np.cumsum(size[docs]) - size[docs]
            xb = (x[rows] - mean) / scale
            h, t, g, a, z, s, n = cls.forward(q, xb, f)
            ds = (s - y[docs]) / len(docs)
            dz = np.repeat(ds[:, None] * q["c"], n, axis=0)
            da = (dz * h).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, f), n))
            dt, dg = de[:, None] * q["w"] * g * (1 - t * t), de[:, None] * q["w"] * t * g * (1 - g)
            dh = (a[:, None] * dz + dt @ q["V"].T + dg @ q["U"].T) * (1 - h * h)
            out = {"W": xb.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}
            return np.concatenate([out[k].ravel() for k in cls.SHAPE]) + 1e-4 * p

        return cls(mean, scale, adam(grad, start, steps, 0.01, 5))

    def score(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        return self.forward(self.parts(self.p), (x - self.mean) / self.scale, first)[5]


def _bags(batches):
    for piece, texts in text_batches(batches):
        x, own = passages(texts)
        bags = []
        for k in range(len(texts)):
            bags.append(x[np.searchsorted(own, k) : np.searchsorted(own, k, "right")].astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(bags, pa.binary())], names=["doc_id", "y", "x"])


def within(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (doc_id, y, text), few enough to list, in the order of a hash until their texts have ``most`` bytes."""
    listed = rows.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64(F.lit(17), "doc_id").alias("h")).collect()
    size, kept = 0, []
    for r in sorted(listed, key=lambda r: (r.h, r.doc_id)):
        if size >= most:
            break
        kept.append((r.doc_id,))
        size += r.n or 0
    if len(kept) == len(listed):
        return rows
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(kept, "doc_id long")), "doc_id", "left_semi")  # at most SAMPLE ids


def train(docs: DataFrame, labels: DataFrame, keep, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Attention | None:
    """Learn from at most ``sample`` labelled documents, chosen by a hash of doc_id among those that ``keep`` allows.

    Every passage of these documents is learnt from.  Passages are held in 16 bits; each step widens those of its batch."""
    rows = within(cut(labelled_texts(docs, label_rows(labels, "quality", keep), sample).select("doc_id", "y", "text")), sample_bytes)
    got = rows.mapInArrow(_bags, "doc_id long, y int, x binary").toArrow()
    if not got.num_rows:
        return None
    bags = [np.frombuffer(b, np.float16).reshape(-1, DIM) for b in got["x"].to_pylist()]
    order = sorted(range(len(bags)), key=lambda k: got["doc_id"][k].as_py())  # not in the order of arrival
    y = np.array([got["y"][k].as_py() for k in order], float) > 0
    own = np.repeat(np.arange(len(order)), [len(bags[k]) for k in order])
    return Attention.train(np.concatenate([bags[k] for k in order]), own, y.astype(float))


def _score(model):
    def run(batches):
        for piece, texts in text_batches(batches):
            s = np.full(len(texts), 0.5) if model.value is None else model.value.score(*passages(texts))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text) against ``labels`` (doc_id, quality).

    held_out: crc32(doc_id as text) mod ``folds`` is ``held`` (false for a null doc_id); labels of such rows are not
    learnt from.  Of conflicting labels of a doc_id the larger counts, null labels don't.  Null texts count as empty; an
    empty text is scored as one empty passage.  All passages of a text are scored, however long it is.  Without a label
    to learn from every score is 0.5.  Repeated rows come back as often as they went in, an empty table gives none;
    columns beside doc_id and text are not read, whatever their names.
    """
    out = remainder(F.col("doc_id"), folds) == held
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, ~out, sample))
    rows = docs.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")
