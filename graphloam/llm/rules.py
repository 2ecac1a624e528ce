"""Quality rules (operator 7): rule statistics and an isolation forest over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, label_rows, text_batches
from .words import DIGIT, LETTER, UPPER, Texts, ascii_space

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Isolation trees, and the rows that each draws from all for its splits: so few by the method, as among many rows anomalies hide each other.
TREES, SUBSAMPLE = 100, 256
#: Scores are rounded to so many digits, so that all labelled rows fit a table of counts by score.
DIGITS = 5
#: Rows that go through all trees at once.
CHUNK = 4096
#: A clean document lost weighs as much as so many bad ones kept.
CLEAN_WEIGHT = 10.0
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 3
PLACE = np.random.default_rng(3).integers(1 << 60, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of many texts (n, 5) counts as in STATS and (n, 8) features for the forest."""
    t = Texts(texts, "ascii")
    ids = t.hasher()(t.start, t.end)
    n, real = t.count, ~ascii_space()[t.x]
    chars, symbols = t.per_text(real), t.per_text(np.isin(t.x, [ord(c) for c in SYMBOLS]))
    kind = t.kind
    alpha, upper, other = t.per_text((kind & 7) == LETTER), t.per_text(kind == LETTER + UPPER), t.per_text(real & (kind != DIGIT) & ((kind & 7) != LETTER))
    wordless = np.bincount(t.own[t.per_word((kind & 7) == LETTER) == 0], minlength=len(n))
    stats = np.zeros((len(texts), 5), np.int64)
    stats[:, 0], stats[:, 1], stats[:, 2] = n, chars, symbols
    distinct, lines = np.zeros(len(texts)), np.zeros(len(texts))
    for k, (text, a, b) in enumerate(zip(texts, t.first.tolist(), (t.first + n).tolist(), strict=True)):
        rows = [x for x in text.split("\n") if x.strip(SPACE)]
        stats[k, 3], lines[k] = len(rows) - len(set(rows)), len(rows)
        if b - a > WINDOW:
            stats[k, 4] = repeated_words(ids[a:b])
            distinct[k] = len(np.unique(ids[a:b]))
    words = np.maximum(n, 1)
    spread = np.minimum(1, distinct / words**0.85)
    x = [symbols / np.maximum(chars, 1), upper / np.maximum(alpha, 1), (other - symbols) / np.maximum(chars, 1), wordless / words, chars / words / 10, stats[:, 3] / np.maximum(lines, 1), stats[:, 4] / words, spread]
    return stats, np.stack(x, 1).astype(float)


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more; ids: hashes of the words, unsigned."""
    with np.errstate(over="ignore"):
        code = (ids[:-2] * PLACE[0]) ^ (ids[1:-1] * PLACE[1] + PLACE[2]) * PLACE[1] ^ (ids[2:] * PLACE[3])
    order = np.argsort(code)
    same = code[order][1:] == code[order][:-1]
    again = np.zeros(len(code), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def _average(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays: of each node the feature, the threshold, its first child and, in leaves, the path length.

    Each tree draws its rows from ``x``; they are rows of its own if there are enough for all trees."""

    def __init__(self, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(x))
        self.high = int(np.ceil(np.log2(max(self.size, 2))))
        feature, threshold, child, length, depths, self.roots = [], [], [], [], [], []
        blanks = ((feature, -1), (threshold, 0.0), (child, 0), (length, 0.0))
        own = rng.permutation(len(x))[: trees * self.size].reshape(trees, -1) if len(x) >= trees * self.size else None
        for tree in range(trees):
            self.roots.append(len(feature))
            todo = [(rng.choice(len(x), self.size, replace=False) if own is None else own[tree], 0, len(feature))]
            depths.append(0)
            for array, blank in blanks:
                array.append(blank)
            while todo:
                rows, depth, k = todo.pop()
                part = x[rows]
                low, top = part.min(0), part.max(0)
                open_ = np.flatnonzero(top > low)
                if depth >= self.high or len(rows) < 2 or not len(open_):
                    length[k] = depth + float(_average(len(rows)))
                    continue
                f = int(rng.choice(open_))
                t = float(rng.uniform(low[f], top[f]))
                feature[k], threshold[k], child[k] = f, t, len(feature)
                left = part[:, f] <= t
                for side in (rows[left], rows[~left]):
                    todo.append((side, depth + 1, len(feature)))
                    depths.append(depth + 1)
                    for array, blank in blanks:
                        array.append(blank)
        self.feature, self.threshold, self.child, self.length, self.depth = map(np.array, (feature, threshold, child, length, depths))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf that each row ends in."""
        node = np.tile(np.array(self.roots), (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.high):
            f = self.feature[node]
            right = x[row, np.maximum(f, 0)] > self.threshold[node]
            node = np.where(f >= 0, self.child[node] + right, node)
        return node

    def weigh(self, mass: np.ndarray) -> None:
        """Path lengths from ``mass``, how many of all rows end in each leaf, in place of how many of the rows drawn."""
        share = mass[self.feature < 0].sum() / len(self.roots)
        self.length = np.where(self.feature < 0, self.depth + _average(mass * (self.size / max(share, 1))), 0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 for anomalies."""
        return 2.0 ** (-self.length[self.leaves(x)].mean(1) / max(float(_average(self.size)), 1e-9))


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])


def threshold(score: np.ndarray, good: np.ndarray, clean_weight: float = CLEAN_WEIGHT) -> float:
    """The score above which a document is rejected: most bad rows caught less ``clean_weight`` times good rows lost."""
    level, of = np.unique(score, return_inverse=True)
    return best_cut(level, np.bincount(of[good], minlength=len(level)), np.bincount(of[~good], minlength=len(level)), clean_weight)


def best_cut(level: np.ndarray, good: np.ndarray, bad: np.ndarray, clean_weight: float = CLEAN_WEIGHT) -> float:
    """The same from distinct scores and how many good and bad rows have each."""
    if not good.sum() or not bad.sum():
        return 1.0
    order = np.argsort(-level)
    caught = np.cumsum(bad[order]) / bad.sum() - clean_weight * np.cumsum(good[order]) / good.sum()
    k = int(np.argmax(caught))
    if caught[k] <= 0:
        return 1.0
    nxt = level[order][k + 1] if k + 1 < len(order) else 0.0
    return float((level[order][k] + nxt) / 2)


def _measure(batches):
    for piece, texts in text_batches(batches):
        stats, x = statistics(texts)
        yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, stats.T.copy()), pa.array(base_failed(stats)), pa.array([row.tobytes() for row in x], pa.binary())], names=["doc_id", *STATS, "base_failed", "x"])


def _features(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(len(column), -1)


def _pieces(batches):
    """Slices of the batches of so many rows that the paths through all trees take little memory."""
    for batch in batches:
        for a in range(0, batch.num_rows, CHUNK):
            yield batch.slice(a, CHUNK)


def _mass(forest):
    """x -> (node, n): how many rows of a partition end in each leaf."""

    def run(batches):
        n = np.zeros(len(forest.value.feature), np.int64)
        for piece in _pieces(batches):
            n += np.bincount(forest.value.leaves(_features(piece.column(0))).ravel(), minlength=len(n))
        node = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n[node])], names=["node", "n"])

    return run


def _scores(forest):
    """x, y -> (anomaly, y)"""

    def run(batches):
        for piece in _pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(forest.value.score(_features(piece.column(0))).round(DIGITS)), piece.column(1)], names=["anomaly", "y"])

    return run


def draw(rows: DataFrame, n: int, total: int) -> DataFrame:
    """``n`` of the ``total`` rows, or all if there are fewer, by a hash of id and features: the same ones in every run."""
    hashed = rows.select("doc_id", "x", F.xxhash64(F.lit(17), "doc_id", "x").alias("h"))
    few = hashed.where(F.pmod("h", F.lit(total)) < 2 * n)  # about twice as many, so that one task needn't sort all
    return (few if total <= 2 * n or few.count() >= n else hashed).orderBy("h", "doc_id", "x").limit(n)


def train(rows: DataFrame, labels: DataFrame) -> tuple[Forest, float] | None:
    """A forest over all rows that pass the base rules, and its threshold from all of these that are labelled.

    rows: (doc_id, statistics, base_failed, x).  Each tree draws the rows for its splits from all; all rows are counted
    in its leaves.  Of a repeated doc_id the row of the most words has the label."""
    context = rows.sparkSession.sparkContext
    passed = rows.where("not base_failed")
    total = passed.count()
    if total < 2:
        return None
    got = draw(passed, TREES * SUBSAMPLE, total).toArrow()
    x = _features(got["x"])
    forest = Forest(x[np.lexsort((*x.T, got["h"].to_numpy()))])
    mass = passed.select("x").mapInArrow(_mass(context.broadcast(forest)), "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(forest.feature))
    n[mass["node"].to_numpy()] = mass["n"].to_numpy()
    forest.weigh(n)
    one = rows.join(label_rows(labels, "quality"), "doc_id").groupBy("doc_id", "y").agg(F.max(F.struct("n_words", "base_failed", "x")).alias("r"))
    levels = one.where("not r.base_failed").select("r.x", "y").mapInArrow(_scores(context.broadcast(forest)), "anomaly double, y int")
    levels = levels.groupBy("anomaly").agg(F.count_if(F.col("y") > 0).alias("good"), F.count_if(F.col("y") <= 0).alias("bad")).toArrow()
    return forest, best_cut(*(levels[c].to_numpy() for c in ("anomaly", "good", "bad")))


def _judge(model):
    """rows -> rows with kept and anomaly in place of x"""

    def run(batches):
        for piece in _pieces(batches):
            bad = piece.column(len(STATS) + 1)
            score = np.zeros(piece.num_rows) if model.value is None else model.value[0].score(_features(piece.column(len(STATS) + 2))).round(DIGITS)
            kept = ~bad.to_numpy(zero_copy_only=False) & (score < (1.0 if model.value is None else model.value[1]))
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(kept), pa.array(score)], names=["doc_id", *STATS, "base_failed", "kept", "anomaly"])

    return run


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly) of every row.

    Words are runs without \\x20 and \\x09-\\x0D.  base_failed: under 50 words, or over half of them in repeated 3-word
    windows.  A row that passes is kept unless its anomaly, the isolation forest's score over all rows that pass, reaches
    the threshold that is calibrated on all labelled rows (the larger of conflicting labels counts; null labels and ids
    don't).  Without a good and a bad one of these every row that passes is kept.  Null texts count as empty.  Texts are
    read whole, however long.  Repeated rows come back as often as they went in, an empty table gives none; columns
    beside doc_id and text are not read, whatever their names.
    """
    kind = "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean"
    rows = cut(docs.select("doc_id", "text").mapInArrow(_measure, f"{kind}, x binary"))
    model = docs.sparkSession.sparkContext.broadcast(train(rows, labels))
    return rows.mapInArrow(_judge(model), f"{kind}, kept boolean, anomaly double")
