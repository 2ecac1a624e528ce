"""LM scoring (operator 4): cross-entropy difference of two bigram models that share one vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, label_rows, mix, small_side, text_batches
from .words import Texts

#: Words and pairs have statistics of their own if they are seen so often over all texts.
LEAST = 2
#: So many most frequent words can stand in pairs; every worker has their statistics (32 bytes each).
VOCABULARY = 1 << 19
#: Most frequent pairs whose statistics every worker has (20 bytes each); others are met in a shuffle.
HELD = 1 << 20
#: Target texts are scored by a model of the other folds' target texts.
FOLDS = 2
#: What is added to the counts of a word or a pair, and to that of a pair's first word.
ADD, ADD_FIRST = 0.5, 1.0
#: Losses are whole numbers of 1/UNIT bits, so that sums don't depend on their order.
UNIT = 1 << 20
#: Bytes of text whose words and pairs one bucket of the table is about.
BUCKET_BYTES = 24 << 20
#: Keys that a worker counts before it hands them on: about 200 MB while they are merged.
COUNTED = 1_200_000
#: Bits of the map of keys that can be in the shuffled part of the table: 16 MB, whatever the size of the corpus.
MAP_BITS = 27
#: The key of a text's end; keys of words are even, those of pairs odd.
END = np.uint64(0x6A09E667F3BCC908)
STEP = np.uint64(0x9E3779B97F4A7C15)
BINS = 512

TABLE, ENTRIES, TEXTS = range(3)


class Line:
    """The tokens of texts one after another: the words of each text and its end."""

    def __init__(self, texts: list[str]):
        t = Texts([x.lower() for x in texts])
        self.n = t.count + 1
        self.own = np.repeat(np.arange(t.n), self.n)
        self.word = np.full(len(self.own), END)
        self.word[np.arange(len(t.own)) + t.own] = mix(t.hasher()(t.start, t.end)) & ~np.uint64(1)
        self.before = np.concatenate((np.array([END]), self.word[:-1]))
        with np.errstate(over="ignore"):
            self.pair = mix(self.before * STEP + self.word) | np.uint64(1)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where each key begins in it)."""
    order = np.argsort(keys)
    k = keys[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(len(k), 1), bool), k[1:] != k[:-1])))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One column of counts for each key of the parts (keys, counts)."""
    if len(parts) == 1:
        return parts[0]
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts], axis=1)
    if not len(keys):
        return keys, counts
    order, at = _groups(keys)
    return keys[order[at]], np.add.reduceat(counts[:, order], at, axis=1)


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as bytes: the first one and the differences, which mostly need six bytes."""
    if not len(keys):
        return b""
    gap = np.diff(keys)
    width = 6 if not len(gap) or int(gap.max()) < 1 << 48 else 8
    return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    gap = np.zeros(((len(data) - 9) // data[0], 8), np.uint8)
    gap[:, : data[0]] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    with np.errstate(over="ignore"):
        return np.cumsum(np.concatenate((np.frombuffer(data[1:9], np.uint64), gap.view(np.uint64).ravel())), dtype=np.uint64)


def narrow(counts: np.ndarray) -> bytes:
    """Rows of counts as bytes, each row in as few bytes a count as its largest one needs."""
    width = [next(w for w in (1, 2, 4, 8) if not len(row) or int(row.max()) < 1 << (8 * w - 1)) for row in counts]
    return bytes(width) + b"".join(row.astype(f"<i{w}").tobytes() for w, row in zip(width, counts, strict=True))


def widened(data: bytes, rows: int) -> np.ndarray:
    width = data[:rows]
    n = (len(data) - rows) // sum(width)
    at = rows + n * np.concatenate(([0], np.cumsum(list(width))))
    return np.stack([np.frombuffer(data, f"<i{w}", n, a).astype(np.int64) for w, a in zip(width, at.tolist(), strict=False)])


def _by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, a, b) of the ascending keys whose first ``bits`` bits are the bucket's number."""
    of = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.diff(of, prepend=-1))
    yield from zip(of[edge].tolist(), edge.tolist(), np.append(edge[1:], len(keys))[: len(edge)].tolist(), strict=True)


def _count(bits: int, folds: int):
    """(m, text) -> (bucket, keys, counts): how often each word and pair is in all texts and in each fold's target texts."""

    def rows(part):
        keys, counts = part
        found = [(b, packed(keys[i:j]), narrow(counts[:, i:j])) for b, i, j in _by_bucket(keys, bits)]
        cols = list(zip(*found, strict=True)) if found else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["bucket", "keys", "counts"])

    def run(batches):
        held = []
        for piece, texts in text_batches(batches):
            line = Line(texts)
            keys = np.concatenate((line.word, line.pair))
            fold = np.tile(piece.column(0).to_numpy(zero_copy_only=False)[line.own], 2)
            order, at = _groups(keys)
            counts = np.zeros((1 + folds, len(at)), np.int32)
            counts[0] = np.diff(np.append(at, len(keys)))
            fold = fold[order]
            for m in range(1, folds + 1):
                counts[m] = np.add.reduceat((fold == m).astype(np.int32), at)
            held.append((keys[order[at]], counts))
            del line, keys, fold, order, at, counts
            if sum(len(k) for k, _ in held) > 1.25 * COUNTED:
                held = [_merged(held)]
                if len(held[0][0]) > COUNTED:
                    yield rows(held.pop())
        if held:
            yield rows(_merged(held))

    return run


def _runs(batches, key: int) -> Iterator[list[dict]]:
    """Rows with the same value of column ``key``, which come together."""
    held: list[dict] = []
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][names[key]] != row[key]:
                yield held
                held = []
            held.append(dict(zip(names, row, strict=True)))
    if held:
        yield held


def _bin(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(n) * 8), BINS - 1).astype(np.int64)


def _add_up(folds: int, least: int):
    """Counted rows of a bucket -> its part of the table: what is seen ``least`` times, and sums over the words."""

    def run(batches):
        for rows in _runs(batches, 0):
            keys, counts = _merged([(unpacked(r["keys"]), widened(r["counts"], 1 + folds)) for r in rows])
            word, often = keys & np.uint64(1) == 0, counts[0] >= least
            total, rare = counts[:, word].sum(1), counts[:, word & ~often].sum(1)
            kind = np.where(word, 0, BINS)[often] + _bin(counts[0, often])
            found = [rows[0]["bucket"], packed(keys[often]), narrow(counts[:, often]), total.tolist(), rare.tolist(), np.bincount(kind, minlength=2 * BINS).tolist()]
            kinds = [pa.int32(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(found, kinds, strict=True)], names=["bucket", "keys", "counts", "total", "rare", "bins"])

    return run


def table_of(flagged: DataFrame, folds: int = FOLDS, least: int = LEAST, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(table, bits): the counts of all words and pairs of ``flagged`` (m, text), m the fold of a target text or 0.

    A row is a bucket of keys with the same first ``bits`` bits: arrays of keys and of their counts as bytes.  Workers
    add up what they meet, so a frequent key is one entry of each worker's; a bucket is about so much text, however much
    there is."""
    size = flagged.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(3, int(np.ceil(np.log2(max(size / bucket_bytes, 1))))), MAP_BITS - 5)
    counted = flagged.mapInArrow(_count(bits, folds), "bucket int, keys binary, counts binary")
    summed = counted.repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_add_up(folds, least), "bucket int, keys binary, counts binary, total array<long>, rare array<long>, bins array<long>")
    return cut(summed), bits


def differences(counts: np.ndarray, total: np.ndarray, add: float) -> np.ndarray:
    """(keys, models): loss under the target less that under the background model, in units.

    Model 0 is of all target texts, model m of those outside fold m.  The background is all texts, its counts scaled to
    the target model's size, so that both are smoothed alike."""
    n, t = counts[0].astype(float), counts[1:].astype(float)
    out = np.empty((counts.shape[1], len(counts)), np.int32)
    for m in range(len(counts)):
        part, size = (x.sum(0) - (x[m - 1] if m else 0) for x in (t, total[1:].astype(float)))
        out[:, m] = np.rint(np.log2((n * (size / max(total[0], 1)) + add) / (part + add)) * UNIT)
    return out


def _frequent(folds: int, total: np.ndarray, bar: tuple[int, int], bits: int, spread: int):
    """A bucket of the table -> (keys and differences of its frequent words and pairs, bits of the map for the others)."""

    def run(batches):
        for rows in _runs(batches, 0):
            for r in rows:  # one: a bucket's row
                keys, counts = unpacked(r["keys"]), widened(r["counts"], 1 + folds)
                word = keys & np.uint64(1) == 0
                held = _bin(np.maximum(counts[0], 1)) >= np.where(word, *bar)
                w, p = word & held, ~word & held
                mine = np.zeros(1 << (spread - bits), bool)
                mine[((keys[~held] >> np.uint64(64 - spread)) - np.uint64(r["bucket"] << (spread - bits))).astype(np.int64)] = True
                out = [r["bucket"], packed(keys[w]), differences(counts[:, w], total, ADD).tobytes(), differences(counts[:, w], total, ADD_FIRST).tobytes(), packed(keys[p]), differences(counts[:, p], total, ADD).tobytes(), np.packbits(mine, bitorder="little").tobytes() if mine.any() else b""]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(out)], names=["bucket", "word", "q", "first", "pair", "p", "bits"])

    return run


class Model:
    """What every worker has: differences of frequent words (as such and as a pair's first), of frequent pairs, of rare words."""

    def __init__(self, table: DataFrame, bits: int, folds: int, vocabulary: int, held: int):
        sums = table.select(F.explode(F.sequence(F.lit(0), F.lit(folds))).alias("k"), "total", "rare").groupBy("k").agg(*(F.sum(F.element_at(c, F.col("k") + 1)).alias(c) for c in ("total", "rare"))).collect()
        self.total, rare = np.zeros(1 + folds, np.int64), np.zeros((1 + folds, 1), np.int64)
        for r in sums:
            self.total[r.k], rare[r.k, 0] = r.total, r.rare
        self.rare = differences(rare, self.total, ADD)[0]
        bins = {r.b: r.n for r in table.select(F.posexplode("bins").alias("b", "n")).where("n > 0").groupBy("b").agg(F.sum("n").alias("n")).collect()}
        bar = []
        for low, most in ((0, vocabulary), (BINS, held)):
            size, least = 0, BINS
            for b in range(BINS - 1, -1, -1):
                size += bins.get(low + b, 0)
                if size > most:
                    break
                least = b
            bar.append(least)
        self.bits, self.spread = bits, max(MAP_BITS, bits + 3)
        found = sorted(table.select("bucket", "keys", "counts").mapInArrow(_frequent(folds, self.total, tuple(bar), bits, self.spread), "bucket int, word binary, q binary, first binary, pair binary, p binary, bits binary").collect(), key=lambda r: r.bucket)
        join = lambda name: b"".join(bytes(r[name]) for r in found)
        self.word, self.pair = (np.concatenate([np.zeros(0, np.uint64), *(unpacked(bytes(r[name])) for r in found)]) for name in ("word", "pair"))
        self.q, self.first, self.p = (np.frombuffer(join(name), np.int32).reshape(-1, 1 + folds) for name in ("q", "first", "p"))
        self.joined = any(r.bits for r in found)
        self.map = b""
        if self.joined:
            full = bytearray(1 << (self.spread - 3))
            for r in found:
                at = r.bucket << (self.spread - bits - 3)
                full[at : at + len(r.bits)] = r.bits
            self.map = bytes(full)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Which keys can be in the part of the table that isn't here."""
        if not self.joined:
            return np.zeros(len(keys), bool)
        k = keys >> np.uint64(64 - self.spread)
        return (np.frombuffer(self.map, np.uint8)[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _at(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where each key is in the ascending ``table``, -1 if it isn't; each distinct key is looked up once."""
    if not len(table):
        return np.full(len(keys), -1)
    one, back = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(table, one), len(table) - 1)
    return np.where(table[at] == one, at, -1)[back]


def _score(sent):
    """(m, doc_id, text) -> (doc_id, n_tokens, score), or, if a part of the table is elsewhere, rows for ``_meet``."""

    def run(batches):
        model = sent.value
        batch = TaskContext.get().partitionId() << 33
        for piece, texts in text_batches(batches):
            line = Line(texts)
            m = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[line.own]
            w, p = _at(line.word, model.word), _at(line.pair, model.pair)
            h = np.concatenate((_at(np.array([END]), model.word), w[:-1]))
            both = (w >= 0) & (h >= 0)
            here = both & (p >= 0)
            s = np.where(w >= 0, model.q[w, m] if len(model.q) else 0, model.rare[m]).astype(np.int64)
            s[here] = model.p[p[here], m[here]].astype(np.int64) - model.first[h[here], m[here]]
            key = np.where(both, line.pair, line.word)
            ask = np.flatnonzero((both & ~here) | (w < 0))
            ask = ask[model.maybe(key[ask])]
            ids = piece.column(1)
            if not model.joined:
                total = np.add.reduceat(s, np.cumsum(line.n) - line.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(line.n, pa.int64()), pa.array(total / (line.n * float(UNIT)), pa.float64())], names=["doc_id", "n_tokens", "score"])
                continue
            # what is asked for counts as the pair less its first word, if it is in the table, and as it is here if not
            first = np.where(both[ask], model.first[h[ask], m[ask]] if len(model.first) else 0, 0).astype(np.int64)
            other = s[ask] + first
            s[ask] = -first
            total = np.add.reduceat(s, np.cumsum(line.n) - line.n)
            doc, k = line.own[ask], key[ask]
            order = np.lexsort((doc, k))
            k, doc = k[order], doc[order]
            new = np.flatnonzero(np.concatenate((np.ones(min(len(k), 1), bool), (k[1:] != k[:-1]) | (doc[1:] != doc[:-1]))))
            times = np.diff(np.append(new, len(k)))
            k, doc, other, of = k[new], doc[new], other[order][new], m[ask][order][new]
            rows = [((batch ^ (batch >> 33)) & ((1 << model.bits) - 1), TEXTS, batch, np.array([i if i is not None else 0 for i in ids.to_pylist()], "<i8").tobytes(), np.concatenate((ids.is_valid().to_numpy(zero_copy_only=False).astype("<i8"), line.n, total)).astype("<i8").tobytes())]
            for b, i, j in _by_bucket(k, model.bits):
                rows.append((b, ENTRIES, batch, packed(k[i:j]), b"".join((doc[i:j].astype("<u4").tobytes(), times[i:j].astype("<u4").tobytes(), other[i:j].astype("<i4").tobytes(), of[i:j].astype(np.uint8).tobytes()))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "kind", "batch", "keys", "data"])
            batch += 1

    return run


def _meet(folds: int, total: np.ndarray):
    """Rows of a bucket, its table first -> (kind, batch, keys, data): the texts' rows as they are, sums for the entries."""

    def run(batches):
        here, known, q = -1, np.zeros(0, np.uint64), np.zeros((0, 1 + folds), np.int32)
        for batch in batches:
            out = []
            for bucket, kind, number, keys, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == TABLE:
                    here, known, q = bucket, unpacked(keys), differences(widened(data, 1 + folds), total, ADD)
                elif kind == TEXTS:
                    out.append((kind, number, keys, data))
                else:
                    k = unpacked(keys)
                    n = len(k)
                    doc, times, other = np.frombuffer(data, "<u4", n), np.frombuffer(data, "<u4", n, 4 * n).astype(np.int64), np.frombuffer(data, "<i4", n, 8 * n).astype(np.int64)
                    of = np.frombuffer(data, np.uint8, n, 12 * n)
                    at = _at(k, known if here == bucket else known[:0])
                    value = other.copy()
                    value[at >= 0] = q[at[at >= 0], of[at >= 0]]
                    docs, back = np.unique(doc, return_inverse=True)
                    sums = np.zeros(len(docs), np.int64)
                    np.add.at(sums, back, value * times)
                    out.append((kind, number, docs.astype("<u4").tobytes(), sums.astype("<i8").tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["kind", "batch", "keys", "data"])

    return run


def _finish(batches):
    """Rows of a batch of texts -> (doc_id, n_tokens, score)."""
    for rows in _runs(batches, 1):
        own = next(r for r in rows if r["kind"] == TEXTS)
        ids = np.frombuffer(own["keys"], "<i8")
        valid, n, total = np.frombuffer(own["data"], "<i8").reshape(3, -1)
        total = total.copy()
        for r in rows:
            if r["kind"] == ENTRIES:
                total[np.frombuffer(r["keys"], "<u4")] += np.frombuffer(r["data"], "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=valid == 0), pa.array(n, pa.int64()), pa.array(total / (n * float(UNIT)), pa.float64())], names=["doc_id", "n_tokens", "score"])


def cross_entropy_difference(docs: DataFrame, target: DataFrame, vocabulary: int = VOCABULARY, folds: int = FOLDS, least: int = LEAST, held: int = HELD, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_tokens, score) of every row of ``docs``: mean bits a token, under the target less the background model.

    Tokens are lower-cased words between white space and the end of the text.  Both models are bigram models of the same
    words and pairs: those seen ``least`` times over all texts (rarer words count as one word).  A pair of two of the
    ``vocabulary`` most frequent words is scored by its count over that of its first word; other tokens by the word's
    count, as a back-off whose weight is the same in both models and drops out.  The background counts every text, the
    target those whose doc_id is in ``target``; background counts are scaled to the target's size, so both models are
    smoothed alike.  A target text is scored by the target texts of the other folds (by a hash of doc_id), so that its
    own words don't speak for it.  Lower scores are more like the target.

    Ids of ``target`` that are null, repeated or not in ``docs`` add nothing.  Null and empty texts are one token, the
    end.  Without target texts every score is 0.  Repeated rows come back as often as they went in; an empty table gives
    none; other columns are not read.  ``held`` and ``bucket_bytes`` only decide how statistics reach the texts.
    Frequent words and pairs are sent to every worker; what else the texts need is asked for bucket by bucket.  Rows of
    ``docs`` must come in the same order if a task runs again, as they do from files and checkpoints.
    """
    ids = cut(target.select("doc_id").where("doc_id is not null").distinct())
    fold = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(folds)) + 1
    flags = ids.select("doc_id", fold.cast("int").alias("m"))
    small = small_side(flags)
    flagged = docs.select("doc_id", "text").join(small, "doc_id", "left").select(F.coalesce("m", F.lit(0)).alias("m"), "doc_id", "text")
    if small is flags:  # a shuffle join gives rows in any order
        flagged = flagged.sortWithinPartitions("doc_id", "text")
    table, bits = table_of(flagged.select("m", "text"), folds, least, bucket_bytes)
    model = Model(table, bits, folds, vocabulary, held)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    if not model.joined:
        return flagged.mapInArrow(_score(sent), "doc_id long, n_tokens long, score double")
    asked = flagged.mapInArrow(_score(sent), "bucket int, kind int, batch long, keys binary, data binary")
    known = table.select("bucket", F.lit(TABLE).alias("kind"), F.lit(-1).cast("long").alias("batch"), "keys", F.col("counts").alias("data"))
    met = asked.unionByName(known).repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket", "kind")
    sums = met.mapInArrow(_meet(folds, model.total), "kind int, batch long, keys binary, data binary")
    return sums.repartition("batch").sortWithinPartitions("batch").mapInArrow(_finish, "doc_id long, n_tokens long, score double")


def score_against_good(docs: DataFrame, labels: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """``cross_entropy_difference`` with the documents that ``labels.quality`` marks 1 as the target."""
    return cross_entropy_difference(docs, label_rows(labels, "quality").where("y = 1").select("doc_id"), vocabulary)
