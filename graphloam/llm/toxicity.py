"""Toxicity (operator 6): voters, a generative label model over them, a linear classifier on its posteriors."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import adam, cut, label_rows, labelled_texts, remainder, sigmoid, text_batches
from .words import Texts, word_hash

#: At most so many labelled documents are learnt from.
SAMPLE = 12_000
#: Lexicon entries (words and word beginnings) that are induced from them at most; every one is a voter.
ENTRIES = 600
BEGINNINGS = (4, 5, 6)
#: Documents of at least this score are taken as toxic.
THRESHOLD = 0.3

# Small lexicons, one voter each.
LEXICONS = {
    "insult": "idiot moron stupid dumb fool loser clown imbecile jerk cretin dimwit".split(),
    "contempt": "scum trash garbage pathetic worthless disgusting filth vermin parasite".split(),
    "profanity": "damn crap bastard bitch asshole shit fuck fucking bullshit".split(),
    "threat": "kill murder die hang shoot destroy beat punch".split(),
}
#: Patterns of lower-cased texts, one voter each, behind a string that a text must hold (none for runs of marks).
PATTERNS = (
    ("you", re.compile(r"\byou(?:'re| are)\s+(?:an?|such|so|all|just)\b")),
    ("shut up", re.compile(r"\bshut up\b")),
    ("go to hell", re.compile(r"\bgo to hell\b")),
    ("", re.compile(r"[!?]{3,}")),
)


def entry_hash(entry: str) -> int:
    """The key of a lexicon entry: a lower-cased word, or a word's beginning with a star."""
    if entry.endswith("*"):
        return word_hash(entry[:-1]) ^ int(STARS[len(entry) - 1])
    return word_hash(entry)


#: Tells beginnings of each length from whole words.
STARS = np.random.default_rng(11).integers(1, 1 << 63, max(BEGINNINGS) + 1, dtype=np.uint64)


def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every word and of every beginning of a longer word; texts must be lower-cased."""
    t = Texts(texts, "letters")
    hasher, size = t.hasher(), t.end - t.start
    own, key = [t.own], [hasher(t.start, t.end)]
    for n in BEGINNINGS:
        long = np.flatnonzero(size > n)
        own.append(t.own[long])
        key.append(hasher(t.start[long], t.start[long] + n) ^ STARS[n])
    return np.concatenate(own), np.concatenate(key)


def _count(batches):
    for piece, texts in text_batches(batches):
        own, key = keys([t.lower() for t in texts])
        order = np.lexsort((own, key))
        own, key = own[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        own, key = own[new], key[new]
        toxic = piece.column(1).to_numpy(zero_copy_only=False)[own] > 0
        found, back = np.unique(key, return_inverse=True)
        pos, both = np.bincount(back, toxic, len(found)).astype(np.int64), np.bincount(back, minlength=len(found))
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(both - pos), pa.array(pos)], names=["entry", "neg", "pos"])


class Votes:
    """Which lexicon entries texts have, and what the pattern and lexicon voters say.

    entries: keys of the induced entries, numbered from 0; then come the fixed lexicons, then the patterns."""

    def __init__(self, entries: list[int]):
        self.n = len(entries)
        number = {int(e): k for k, e in enumerate(entries)}
        pairs = [*number.items(), *((word_hash(w), self.n + k) for k, ws in enumerate(LEXICONS.values()) for w in ws)]
        pairs.sort()
        self.key = np.array([a for a, _ in pairs], np.uint64)
        self.number = np.array([b for _, b in pairs], np.int64)
        self.width = self.n + len(LEXICONS) + len(PATTERNS)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, voter) of every vote, each once, sorted."""
        low = [t.lower() for t in texts]
        own, key = keys(low)
        parts = []
        for side in ("left", "right"):  # a key can stand twice: as an induced entry and in a fixed lexicon
            at = np.searchsorted(self.key, key, side) - (side == "right")
            at = np.clip(at, 0, len(self.key) - 1)
            hit = np.flatnonzero(self.key[at] == key)
            parts.append(own[hit] * self.width + self.number[at[hit]])
        for k, (hint, pattern) in enumerate(PATTERNS):
            found = [j for j, t in enumerate(low) if hint in t and pattern.search(t)]
            parts.append(np.array(found, np.int64) * self.width + self.n + len(LEXICONS) + k)
        both = np.unique(np.concatenate(parts))
        return both // self.width, both % self.width


def _vote(entries):
    def run(batches):
        votes = Votes(entries)
        for piece, texts in text_batches(batches):
            own, voter = votes(texts)
            cuts = np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.ListArray.from_arrays(pa.array(cuts), pa.array(voter.astype(np.int32)))], names=["doc_id", "y", "hits"])

    return run


def together(a: np.ndarray, b: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The chance that two events of chances ``a`` and ``b`` with the odds ratio ``odds`` both happen."""
    s = 1 + (a + b) * (odds - 1)
    root = np.sqrt(np.maximum(s * s - 4 * odds * (odds - 1) * a * b, 0))
    apart = np.abs(odds - 1) > 1e-9
    return np.where(apart, (s - root) / np.where(apart, 2 * (odds - 1), 1), a * b)


class LabelModel:
    """A generative model of binary voters that fire or don't, given a hidden class; the given label is one of them.

    EM starts at the given labels and estimates the share of class 1, how often each voter fires in either class (``fire``,
    so its accuracy), and which voters are correlated beyond what the class explains.  Correlated pairs form a forest
    (the strongest residual correlations, of STRONG at least): a voter's chance then depends on its parent's vote, by an
    odds ratio that both classes share.  Votes that say the same thing thus count about once, and the given label, whose
    accuracy is estimated like any other, is overturned where the voters outweigh it.
    """

    STRONG = 0.6

    def __init__(self, votes: np.ndarray, given: np.ndarray, rounds: int = 40):
        v = np.concatenate([votes, given[:, None]], 1).astype(np.float32)
        self.parent, self.odds = np.full(v.shape[1], -1), np.ones(v.shape[1])
        p = 0.9 * given + 0.05
        for t in range(rounds):
            self._fit(v, p, t % 5 == 4)
            q = self._posterior(v)
            still = np.abs(q - p).max() < 1e-4
            p = q
            if still and t > 5:
                break

    def _fit(self, v: np.ndarray, p: np.ndarray, correlate: bool) -> None:
        n = len(v)
        weight = np.stack([1 - p, p]).astype(np.float32)
        total, fired = weight.sum(1).astype(float), (weight @ v).astype(float)
        self.prior = (total[1] + 1) / (n + 2)
        self.fire = np.clip((fired + np.array([[0.05], [0.2]])) / (total[:, None] + 1), 1e-4, 1 - 1e-4)
        if correlate:
            self._correlate(v, weight, total, fired)

    def _correlate(self, v, weight, total, fired) -> None:
        n, m = v.shape
        both = np.stack([(v.T @ (w[:, None] * v)) for w in weight]).astype(float)
        only, neither = fired[:, :, None] - both, total[:, None, None] - fired[:, :, None] - fired[:, None, :] + both
        odds = ((both * neither / total[:, None, None].clip(1e-9)).sum(0) + 0.5) / ((only * only.transpose(0, 2, 1) / total[:, None, None].clip(1e-9)).sum(0) + 0.5)
        gain = np.zeros((m, m))  # of log-likelihood, by a pair's odds ratio
        for k in (0, 1):
            a, b = self.fire[k][:, None], self.fire[k][None]
            ab = together(a, b, odds)
            for count, chance, alone in ((both[k], ab, a * b), (only[k], a - ab, a * (1 - b)), (only[k].T, b - ab, (1 - a) * b), (neither[k], 1 - a - b + ab, (1 - a) * (1 - b))):
                gain += count * np.log(np.clip(chance, 1e-12, 1) / np.clip(alone, 1e-12, 1))
        mean = (total[0] * self.fire[0] + total[1] * self.fire[1]) / n
        cov = both.sum(0) - sum(fired[k][:, None] * self.fire[k][None] + self.fire[k][:, None] * fired[k][None] - total[k] * self.fire[k][:, None] * self.fire[k][None] for k in (0, 1))
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9 + 0 * mean))
        self.correlation = cov / sd[:, None] / sd[None]
        np.fill_diagonal(self.correlation, 0)
        strong = np.where((self.correlation >= self.STRONG) & (gain > 3 * np.log(max(n, 2))), self.correlation, 0)
        self.parent = np.full(m, -1)
        best, via, left = np.zeros(m), np.full(m, -1), np.ones(m, bool)
        for _ in range(m):  # a spanning forest of the strongest pairs
            k = int(np.where(left, best, -1).argmax())
            left[k] = False
            self.parent[k] = via[k] if best[k] > 0 else -1
            closer = left & (strong[k] > best)
            best[closer], via[closer] = strong[k][closer], k
        self.odds = np.where(self.parent >= 0, odds[np.arange(m), self.parent], 1.0)

    @property
    def pairs(self) -> list[tuple[int, int, float]]:
        """(voter, the voter that it depends on, odds ratio)."""
        return [(int(k), int(self.parent[k]), float(self.odds[k])) for k in np.flatnonzero(self.parent >= 0)]

    @property
    def accuracy(self) -> np.ndarray:
        """How often each voter agrees with the hidden class; the given label's is the last."""
        return self.prior * self.fire[1] + (1 - self.prior) * (1 - self.fire[0])

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        child = np.flatnonzero(self.parent >= 0)
        up = self.parent[child]
        one, two, const = np.zeros(v.shape[1]), np.zeros(len(child)), np.log(self.prior / (1 - self.prior))
        for sign, fire in ((-1, self.fire[0]), (1, self.fire[1])):
            alone = np.where(self.parent >= 0, 0, np.log(fire / (1 - fire)))
            const += sign * np.log(1 - fire[self.parent < 0]).sum()
            ab = together(fire[child], fire[up], self.odds[child])
            with_up = np.clip(ab / fire[up], 1e-5, 1 - 1e-5)
            without = np.clip((fire[child] - ab) / (1 - fire[up]), 1e-5, 1 - 1e-5)
            np.add.at(alone, child, np.log(without / (1 - without)))
            np.add.at(alone, up, np.log((1 - with_up) / (1 - without)))
            const += sign * np.log(1 - without).sum()
            one += sign * alone
            two += sign * (np.log(with_up / (1 - with_up)) - np.log(without / (1 - without)))
        pair = v[:, child] * v[:, up]
        return sigmoid(const + v @ one + pair @ two)

    def posterior(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        return self._posterior(np.concatenate([votes, given[:, None]], 1).astype(np.float32))


def learn(hits: list[list[int]], y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier, learnt from the label model's posteriors."""
    x = np.zeros((len(hits), width), np.float32)
    for k, h in enumerate(hits):
        x[k, h] = 1
    posterior = LabelModel(x, y).posterior(x, y).astype(np.float32)

    def grad(p, _, __):
        w = p.astype(np.float32)
        e = (sigmoid(x @ w[:-1] + w[-1]) - posterior) / len(x)
        return np.append(x.T @ e + 2e-5 * w[:-1], e.sum())

    p = adam(grad, np.append(np.zeros(width), -2.0), 400, 0.15)
    return p[:-1].astype(np.float32), float(p[-1])


def train(docs: DataFrame, labels: DataFrame, keep, sample: int = SAMPLE):
    """(entries, weights, bias) from at most ``sample`` labelled documents, or None."""
    rows = cut(labelled_texts(docs, label_rows(labels, "toxic", keep), sample).select("doc_id", "y", "text"))
    counts = rows.mapInArrow(_count, "entry long, neg long, pos long").groupBy("entry").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    total = rows.agg(F.count("*").alias("n"), F.sum((F.col("y") > 0).cast("long")).alias("pos")).first()
    if not total.n or not total.pos or total.pos == total.n:
        return None
    pos, neg = total.pos, total.n - total.pos
    lift = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    best = counts.where("pos >= 3").withColumn("lift", lift).where("lift > 1.5").withColumn("rank", F.col("pos") * F.col("lift"))
    entries = [r.entry & ((1 << 64) - 1) for r in best.orderBy(F.desc("rank"), "entry").limit(ENTRIES).select("entry").collect()]
    votes = Votes(entries)
    got = sorted(rows.mapInArrow(_vote(entries), "doc_id long, y int, hits array<int>").collect(), key=lambda r: (r.doc_id, r.y))
    weights, bias = learn([r.hits for r in got], np.array([float(r.y > 0) for r in got]), votes.width)
    return entries, weights, bias


def _scores(votes: Votes, texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    own, voter = votes(texts)
    return sigmoid(np.bincount(own, weights[voter], len(texts)) + bias)


def _score(model):
    def run(batches):
        entries, weights, bias = model.value or ([], None, 0.0)
        votes = Votes(entries)
        for piece, texts in text_batches(batches):
            s = np.zeros(len(texts)) if weights is None else _scores(votes, texts, weights, bias)
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(s, pa.float64())], names=[*piece.schema.names[:-1], "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text) against ``labels`` (doc_id, toxic).

    held_out: crc32(doc_id as text) mod ``folds`` is ``held`` (false for a null doc_id); labels of such rows are not
    learnt from.  Of conflicting labels of a doc_id the larger counts, null labels don't.  Null texts count as empty;
    an empty text has no votes and is scored by the bias alone.  Texts are read whole, however long.  Without toxic and
    other labels to learn from every score is 0.  predicted: 1 if the score is at least THRESHOLD.  Repeated rows come
    back as often as they went in, an empty table gives none; columns beside doc_id and text are not read, whatever their
    names.
    """
    out = remainder(F.col("doc_id"), folds) == held
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, ~out, sample))
    rows = docs.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "text")
    scored = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose score is under THRESHOLD, with all their columns; see ``score_toxicity``."""
    out = remainder(F.col("doc_id"), folds) == held
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, ~out, sample))

    def run(batches):
        entries, weights, bias = model.value or ([], None, 0.0)
        votes = Votes(entries)
        for piece, texts in text_batches(batches):
            if weights is not None:
                s = _scores(votes, texts, weights, bias)
                piece = piece.filter(pa.array(s < THRESHOLD))
            yield piece

    return docs.mapInArrow(run, docs.schema)
