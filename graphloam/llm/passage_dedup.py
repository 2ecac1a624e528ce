"""Passage dedup (operator 3): repeated runs of fifty words, wherever they begin and end in the lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, mix, release, text_batches
from .decontaminate import MAP_BITS, _map_of
from .line_dedup import KEYS, _keyed, line_dedup_report
from .words import Texts, prefix_sums

WORDS = 50
#: Characters that a worker hashes at once: its arrays then stay in the processor's cache.
CHUNK_CHARS = 250_000
#: Makes a second code of each word, for the second half of a hash.
SALT = np.uint64(0x5851F42D4C957F2D)
_KEYS = "__ld_id long, __ld_null boolean, __ld_th long"


class Sums:
    """Hashes of any ranges of an array of codes."""

    def __init__(self, code: np.ndarray):
        self.sums, self.down = prefix_sums(code)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start])


def _rolled(code: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` codes."""
    start = np.arange(max(len(code) - size + 1, 0))
    return Sums(code)(start, start + size)


def _coded(texts: list[str], words: int):
    """The texts' words, the hash of each, and where windows of ``words`` words begin that lie within one text."""
    t = Texts(texts, "ascii")
    code = mix(t.hasher()(t.start, t.end))
    n = max(len(code) - words + 1, 0)
    return t, code, np.flatnonzero(t.own[:n] == t.own[len(code) - n :])


def _first_lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Where each run of ``width`` numbers has its smallest (the first one): from runs of 1, 2, 4 ... numbers."""
    at, size = np.arange(len(x)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at = np.where(x[right] < x[left], right, left)
        size += step
    return at


def _lowest(code: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of half as many words as a window has, and where each window has its smallest (the first one)."""
    part = words // 2
    g = _rolled(code, part)
    return g, _first_lowest(g, words - part + 1)[at] if len(at) else at


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    k = h >> np.uint64(64 - MAP_BITS)
    return (bits[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _minima(words: int):
    """keys, text -> (wh): the smallest hashes of all windows, one for each place where they stand."""

    def run(batches):
        for _, texts in text_batches(batches, chars=CHUNK_CHARS):
            _, code, at = _coded(texts, words)
            g, low = _lowest(code, at, words)
            yield pa.RecordBatch.from_arrays([pa.array(g[np.unique(low)].view(np.int64))], names=["wh"])

    return run


def _spans(words: int, seen):
    """keys, text -> (keys, wh, a, b, sh): the windows a to b with one smallest hash at one place, and a hash of all their words."""

    def run(batches):
        bits = np.frombuffer(seen.value, np.uint8)
        for piece, texts in text_batches(batches, chars=CHUNK_CHARS):
            t, code, at = _coded(texts, words)
            g, low = _lowest(code, at, words)
            first = np.flatnonzero(np.diff(low, prepend=-1))
            last = np.append(first[1:], len(low))[: len(first)] - 1
            hit = _held(bits, g[low[first]])
            first, last = first[hit], last[hit]
            sums = Sums(mix(code ^ SALT))
            sh = sums(at[first], at[last] + words) ^ mix((last - first).astype(np.uint64) << np.uint64(32) | (low[first] - at[first]).astype(np.uint64))
            of = t.own[at[first]]
            keys = [piece.column(k).take(pa.array(of)) for k in range(3)]
            ends = [pa.array((at[x] - t.first[of]).astype(np.int32)) for x in (first, last)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(g[low[first]].view(np.int64)), *ends, pa.array(sh.view(np.int64))], names=[*KEYS, "wh", "a", "b", "sh"])

    return run


def later_ones(h1: np.ndarray, h2: np.ndarray, order: list[np.ndarray]) -> np.ndarray:
    """Of rows with equal hashes all but the first one in the order of the columns ``order``, and but what equals it there."""
    later = np.zeros(len(h1), bool)
    by = np.argsort(h1)
    same = h1[by][1:] == h1[by][:-1]
    some = by[np.append(same, False) | np.append(False, same)] if len(by) else by
    some = some[np.lexsort([x[some] for x in (*order[::-1], h2, h1)])]
    new = np.append(True, (h1[some][1:] != h1[some][:-1]) | (h2[some][1:] != h2[some][:-1]))[: len(some)]
    first = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
    later[some] = np.any([x[some] != x[first] for x in order], 0)
    return later


def _windows(words: int, seen, within):
    """keys, text -> (keys, h1, h2, pos, salt): the windows whose smallest hash is in the map ``seen``; texts whose hash isn't in ``within`` have none.

    salt: zero for those that may be the first of their kind; those that another one in their batch precedes have the
    text's hash with its lowest bit set, so that no place has to take all copies of a frequent window."""

    def run(batches):
        bits, some = np.frombuffer(seen.value, np.uint8), np.frombuffer(within.value, np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(_held(some, batch.column(2).to_numpy().view(np.uint64))))
            out = []
            for piece, texts in text_batches([batch], chars=CHUNK_CHARS):
                t, code, at = _coded(texts, words)
                g, low = _lowest(code, at, words)
                at = at[_held(bits, g[low])]
                of = t.own[at]
                keys = [piece.column(k).to_numpy(zero_copy_only=False)[of] for k in range(3)]
                out.append([*keys, *(Sums(c)(at, at + words).view(np.int64) for c in (code, mix(code ^ SALT))), (at - t.first[of]).astype(np.int32)])
            if out:
                ids, null, th, h1, h2, pos = map(np.concatenate, zip(*out, strict=True))
                salt = np.where(later_ones(h1, h2, [null, ids, th, pos]), th | 1, 0)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (ids, null, th, h1, h2, pos, salt))], names=[*KEYS, "h1", "h2", "pos", "salt"])

    return run


def merge_spans(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans a to b - 1 of each row, merged where they overlap or touch, in order."""
    order = np.lexsort((a, row))
    row, a = row[order], a[order]
    reach = np.maximum.accumulate((row << 32) + b[order])  # of a row's spans so far; no earlier row's is larger
    first = np.ones(len(a), bool)
    first[1:] = ((row << 32) + a)[1:] > reach[:-1]
    last = np.append(np.flatnonzero(first), len(a))[1:] - 1
    return row[first], a[first], reach[last] & 0xFFFFFFFF


def _merged(words: int):
    """keys, spans -> (keys, __ld_cut): the words a to b - 1 that the windows of the spans cover, merged."""

    def run(batches):
        for batch in batches:
            col = batch.column(3)
            size = np.diff(col.offsets.to_numpy())
            a, b = (x.to_numpy().astype(np.int64) for x in col.flatten().flatten())
            row, a, b = merge_spans(np.repeat(np.arange(len(size)), size), a, b + words)
            ends = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["a", "b"])
            edges = np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(edges), ends)], names=[*KEYS, "__ld_cut"])

    return run


def without(text: str, cuts: list[dict]) -> str:
    """``text`` without the words a to b - 1 of each of ``cuts``, which are sorted and apart.

    The space after a cut goes with it, or the one before if only the one after holds a line end or the text ends."""
    t = Texts([text], "ascii")
    out, kept = [], 0
    for i, j in ((x["a"], x["b"]) for x in cuts):
        a, b = int(t.start[i]), int(t.end[j - 1])
        before, after = int(t.end[i - 1]) if i else 0, int(t.start[j]) if j < len(t.start) else len(text)
        if j == len(t.start) or ("\n" in text[b:after] and "\n" not in text[before:a]):
            a = max(before, kept)
            b = after if j == len(t.start) else b
        else:
            b = after
        out.append(text[kept:a])
        kept = b
    return "".join([*out, text[kept:]])


def passage_dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with every later occurrence of a repeated run of ``words`` or more words cut out of ``text``.

    Words are what ASCII white space parts; line ends count as space, so a passage may begin and end inside lines.
    Windows are compared by 128 bits of hash with all that can be equal.  Equal windows have the same smallest hash
    among their runs of half as many words, so a bit map of the smallest hashes that stand at two places rules out most
    text.  Neighbouring windows that share one are a span: where all spans of a smallest hash are equal a span is one
    row, else each window is; a bit map of texts says which hold such spans.  The first occurrence is the one with the smallest doc_id (null last), then text hash,
    then position; what later ones cover is merged and removed.  Null texts stay null, rows are never dropped, identical
    rows are one document.  All columns come back, ``text`` changed.
    """
    keyed = _keyed(docs)
    texts = keyed.select(*KEYS, "text").where("text is not null")
    twice = texts.mapInArrow(_minima(words), "wh long").groupBy("wh").agg(F.count("*").alias("n")).where("n > 1")
    spans = cut(texts.mapInArrow(_spans(words, _map_of(twice)), f"{_KEYS}, wh long, a int, b int, sh long"))

    at = lambda pos: F.struct(F.col("__ld_null"), F.col("__ld_id"), F.col("__ld_th"), F.col(pos))
    kinds = cut(spans.groupBy("wh").agg(F.count("*").alias("n"), F.min("sh").alias("low"), F.max("sh").alias("high"), F.min(at("a")).alias("first")).where("n > 1"))
    whole = spans.join(kinds.where("low = high").select("wh", "first"), "wh").where(at("a") != F.col("first")).select(*KEYS, "a", "b")

    mixed = kinds.where("low <> high").select("wh")
    within = cut(spans.join(mixed, "wh", "left_semi").select(F.col("__ld_th").alias("wh")).distinct())
    some = _map_of(within)
    if within.count() <= BROADCAST_ROWS:  # else the map alone tells these texts
        texts = texts.join(F.broadcast(within), F.col("__ld_th") == F.col("wh"), "left_semi")
    seen = texts.mapInArrow(_windows(words, _map_of(mixed), some), f"{_KEYS}, h1 long, h2 long, pos int, salt long")
    place = F.rank().over(Window.partitionBy("h1", "h2", "salt").orderBy("__ld_null", "__ld_id", "__ld_th", "pos"))
    single = seen.withColumn("place", place).where("salt <> 0 or place > 1").select(*KEYS, F.col("pos").alias("a"), F.col("pos").alias("b"))
    starts = whole.unionByName(single).groupBy(*KEYS).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    starts = cut(starts.mapInArrow(_merged(words), f"{_KEYS}, __ld_cut array<struct<a int, b int>>"))
    if (starts.agg(F.sum(F.size("__ld_cut"))).first()[0] or 0) <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    marked = keyed.join(starts, KEYS, "left").select(*docs.columns, "__ld_cut")
    names, place = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            text = [without(t, c) for t, c in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[place] = pa.array(text, batch.column(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    same = marked.where("__ld_cut is null").select(*names)
    return same.unionByName(marked.where("__ld_cut is not null").mapInArrow(run, docs.schema))


def dedup_report(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_cut, text) of every row of ``docs``: ``line_dedup``, then ``passage_dedup`` of what it left.

    n_lines and n_removed count lines before and cut by the first, n_cut the characters that the second took."""
    lines = cut(line_dedup_report(docs))
    release(docs.sparkSession)
    lines = lines.withColumn("n_cut", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    out = passage_dedup(lines, words)
    return out.withColumn("n_cut", F.col("n_cut") - F.coalesce(F.char_length("text"), F.lit(0)))
