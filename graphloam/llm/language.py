"""Language identification (operator 10): the family first, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import adam, bounded_ids, cut, remainder, text_batches

#: Hashed character bigrams and trigrams.
DIM = 2048
#: At most so many rows are learnt from.
SAMPLE = 4000
#: Characters of one text that are counted at once.
SLICE = 1_000_000

# Families of common language codes; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indo-aryan": "hi bn ur mr gu pa ne si".split(),
    "semitic": "ar he mt am".split(),
    "baltic": "lt lv".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].lower(), f"own:{lang}")


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def features(texts: list[str], size: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """(n, DIM) unit vectors of the square roots of n-gram counts, and which texts have a letter.

    A long text is counted in slices of ``size`` characters; two code points are carried from one to the next, so that
    every n-gram counts once, wherever the slices end."""
    out, some = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), bool)
    a, b, c = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
    for k, text in enumerate(texts):
        text = f"{text.lower()} "
        carried = np.array([32], np.uint32)
        for at in range(0, len(text), size):
            x = np.frombuffer(text[at : at + size].encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = _letters()[x]
            some[k] |= letter.any()
            x = np.concatenate((carried, np.where(letter, x, np.uint32(32))))
            x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]  # runs of other characters are one
            with np.errstate(over="ignore"):
                two = x[:-1] * a + x[1:] * b
                three = two[:-1] + x[2:] * c
                two = two[len(carried) - 1 :]  # the pair that was carried has been counted
                h = np.concatenate((two ^ (two >> np.uint32(15)), three ^ (three >> np.uint32(13)))) * np.uint32(0x9E3779B1)
            out[k] += np.bincount(h >> np.uint32(21), minlength=DIM)
            carried = x[-2:]
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), some


def svm(x: np.ndarray, y: np.ndarray, steps: int = 200, penalty: float = 1e-4) -> np.ndarray:
    """Weights and bias of linear SVMs (squared hinge, balanced classes); y: (n, k) of +1, -1, one column a problem."""
    n, d = x.shape
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / np.maximum((y > 0).sum(0), 1), 0.5 / np.maximum((y < 0).sum(0), 1)).astype(np.float32)

    def grad(p, _, __):
        w = p.reshape(d + 1, -1).astype(np.float32)
        slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])) * weight * y
        return np.concatenate((-2 * (x.T @ slack) + 2 * penalty * w[:-1], -2 * slack.sum(0, keepdims=True))).ravel()

    return adam(grad, np.zeros((d + 1) * y.shape[1]), steps, 0.3).reshape(d + 1, -1).astype(np.float32)


class Model:
    """families: names; root: one-versus-rest SVMs over them; pairs: (language, language) -> SVM inside a family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = np.array(langs)
        of = np.array([family(v) for v in langs])
        self.families = sorted(set(of.tolist()))
        self.members = {f: sorted(set(names[of == f].tolist())) for f in self.families}
        self.root = svm(x, np.stack([np.where(of == f, 1.0, -1.0) for f in self.families], 1)) if len(self.families) > 1 else None
        self.pairs = {}
        for f in self.families:
            for one, two in combinations(self.members[f], 2):
                mine = (names == one) | (names == two)
                self.pairs[one, two] = svm(x[mine], np.where(names[mine] == one, 1.0, -1.0)[:, None])

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        margin = np.zeros((n, 1)) if self.root is None else x @ self.root[:-1] + self.root[-1]
        p = np.exp(4 * (margin - margin.max(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        lang, score = np.empty(n, object), p[np.arange(n), best]
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            codes = self.members[f]
            votes = np.zeros((len(rows), len(codes)))
            for i, j in combinations(range(len(codes)), 2):
                w = self.pairs[codes[i], codes[j]]
                m = 1 / (1 + np.exp(-4 * np.clip(x[rows] @ w[:-1, 0] + w[-1, 0], -9, 9)))
                votes[:, i] += m
                votes[:, j] += 1 - m
            win = votes.argmax(1)
            lang[rows] = np.array(codes, object)[win]
            if len(codes) > 1:
                score[rows] *= votes[np.arange(len(rows)), win] / (len(codes) - 1)
        return lang, np.clip(score, 0, 1)


def _features_of_rows(batches):
    for piece, texts in text_batches(batches):
        x, some = features(texts)
        keep = np.flatnonzero(some)
        yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(keep)), pa.array([x[k].tobytes() for k in keep], pa.binary())], names=["lang", "x"])


def train(docs: DataFrame, keep, sample: int = SAMPLE) -> Model | None:
    """Learn from at most ``sample`` rows (by a hash of doc_id) of those that ``keep`` allows and whose lang isn't null.

    Of a repeated doc_id the row of the largest lang and text counts."""
    rows = docs.select("doc_id", "lang").where("lang is not null and doc_id is not null").where(keep)
    ids = cut(bounded_ids(rows.select("doc_id").distinct(), sample))
    taken = docs.where("lang is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max(F.struct("lang", "text")).alias("r"))
    got = taken.select("r.lang", "r.text").mapInArrow(_features_of_rows, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, DIM)
    return Model(x, got["lang"].to_pylist())


def _predict(model):
    def run(batches):
        for piece, texts in text_batches(batches):
            x, some = features(texts)
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if model.value is not None and some.any():
                lang[some], score[some] = model.value.predict(x[some])
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang).

    held_out: crc32(doc_id as text) mod ``folds`` is ``held`` (false for a null doc_id); such rows, rows of a null lang
    or doc_id and texts without a letter are not learnt from.  A null text or one without a letter is ``und`` with
    score 0, as is everything if there is nothing to learn from.  Texts are read whole, however long.  Repeated rows come
    back as often as they went in, an empty table gives none; other columns are not read, whatever their names.
    """
    out = remainder(F.col("doc_id"), folds) == held
    model = docs.sparkSession.sparkContext.broadcast(train(docs, ~out, sample))
    rows = docs.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
