"""SimHash near-duplicates (operator 5): fingerprints, a binary-trie self-join, connected components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import cut, small_side, text_batches

#: Five blocks of the 64 bits.  Two differing bits touch two blocks at most, so three blocks are equal.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
MAX_BITS = 2
#: Node pairs that the traversal expands at once.
FRONTIER = 1 << 18


def fingerprint(text: str, words: int = 3) -> int:
    """The fingerprint of one text: of each bit, whether over half the shingles' hashes have it."""
    w = text.encode().lower().split()
    if not w:
        return 0
    flat = b" ".join(w)
    if len(w) <= words:
        h = np.array([xxhash.xxh64_intdigest(flat, 42)], dtype="<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        cuts = zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
        h = np.fromiter((digest(flat[a:b], 42) for a, b in cuts), "<u8", len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # a long text's bits are unpacked in slices
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches):
        for piece, texts in text_batches(batches):
            fp = np.fromiter((fingerprint(t, words) for t in texts), "<u8", len(texts))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(fp.view("<i8"))], names=["doc_id", "th", "fp"])

    return run


def trie_links(values: np.ndarray, group: np.ndarray, bits: np.ndarray, budget: int = MAX_BITS):
    """Pairs (i, j), i < j, of rows in one group whose values differ in ``budget`` bits at most.

    values: unsigned 64-bit, sorted within each group; group: ascending; bits: the bits, from the highest, that can
    differ.  Each group is the root of a binary trie whose nodes are ranges of rows.  Pairs of nodes go down together;
    a pair that takes different branches spends one bit of the budget, and is dropped when the budget is exceeded.
    """
    n = len(values)
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if n else np.zeros(1, np.int64)
    lo, hi = edges[:-1], edges[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    cums: dict[int, np.ndarray] = {}

    def ones(depth: int) -> np.ndarray:
        if depth not in cums:
            cums[depth] = np.concatenate(([0], np.cumsum((values >> np.uint64(bits[depth])) & np.uint64(1)).astype(np.int64)))
        return cums[depth]

    # a frontier: depth, then for each node pair the two ranges and the bits spent
    todo = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while todo:
        depth, al, ah, bl, bh, err = todo.pop()
        if not len(al):
            continue
        if len(al) > FRONTIER:
            for k in range(0, len(al), FRONTIER):
                todo.append((depth, *(x[k : k + FRONTIER] for x in (al, ah, bl, bh, err))))
            continue
        leaf = (ah - al == 1) & (bh - bl == 1) & (al != bl)
        if leaf.any():  # two rows: what is left of the way down is one comparison
            i, j = al[leaf], bl[leaf]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            yield i[near], j[near]
            al, ah, bl, bh, err = (x[~leaf] for x in (al, ah, bl, bh, err))
        if depth == len(bits) or not len(al):
            if len(al):  # equal values: every pair of the two ranges
                raise ValueError("values of a group must be distinct")
            continue
        c = ones(depth)
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        own = al == bl
        parts = [(al, am, bl, bm, err, True), (am, ah, bm, bh, err, True), (al, am, bm, bh, err + 1, True), (am, ah, bl, bm, err + 1, ~own)]
        out = []
        for a0, a1, b0, b1, e, also in parts:
            ok = (a1 > a0) & (b1 > b0) & (e <= budget) & also
            ok &= ~((a0 == b0) & (a1 - a0 == 1))  # a row with itself
            out.append([x[ok] for x in (a0, a1, b0, b1, e)])
        todo.append((depth + 1, *(np.concatenate(x) for x in zip(*out, strict=True))))


def _roots(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray) -> None:
    """Merge the links into ``root`` (each row's smallest known row), until nothing changes."""
    while True:
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root[:] = root[root]
        if (root == before).all() and (root[i] == root[j]).all():
            return


def _links(budget: int):
    """Sorted (combo, key, fp) rows in, one link (fp, root) for each row that has a smaller partner in its group."""

    def solve(combo: int, key: np.ndarray, fp: np.ndarray):
        inside = [b for k in COMBOS[combo] for b in range(BLOCKS[k][0], sum(BLOCKS[k]))]
        bits = np.array([b for b in range(63, -1, -1) if b not in set(inside)], np.int64)
        alone = np.concatenate(([True], key[1:] != key[:-1], [True]))
        keep = ~(alone[:-1] & alone[1:])
        key, fp = key[keep], fp[keep]
        if not len(key):
            return None
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        root = np.arange(len(fp))
        for i, j in trie_links(fp, key, bits, budget):
            _roots(len(fp), i, j, root)
        linked = np.flatnonzero(root != np.arange(len(fp)))
        if not len(linked):
            return None
        return pa.RecordBatch.from_arrays([pa.array(fp[linked].view("<i8")), pa.array(fp[root[linked]].view("<i8"))], names=["a", "b"])

    def run(batches):
        held: list[tuple] = []  # rows since the last change of combo or, when many, of key
        rows = 0
        for batch in batches:
            combo = batch.column(0).to_numpy(zero_copy_only=False)
            key = batch.column(1).to_numpy(zero_copy_only=False)
            fp = batch.column(2).to_numpy(zero_copy_only=False).view("<u8")
            for a, b in zip(x := np.flatnonzero(np.concatenate(([True], combo[1:] != combo[:-1]))), [*x[1:], len(combo)], strict=True):
                if held and held[0][0] != combo[a]:
                    if (out := solve(held[0][0], *map(np.concatenate, zip(*(h[1:] for h in held), strict=True)))) is not None:
                        yield out
                    held, rows = [], 0
                held.append((int(combo[a]), key[a:b], fp[a:b]))
                rows += b - a
            if rows > 1_000_000:  # all keys but the last are complete
                c, k, f = held[0][0], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
                done = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
                if done:
                    if (out := solve(c, k[:done], f[:done])) is not None:
                        yield out
                    held, rows = [(c, k[done:], f[done:])], len(k) - done
        if held and (out := solve(held[0][0], *map(np.concatenate, zip(*(h[1:] for h in held), strict=True)))) is not None:
            yield out

    return run


COMBOS = tuple(combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_BITS))


def link_fingerprints(distinct: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that span every group at ``budget`` <= 2 differing bits."""
    if not 0 <= budget <= MAX_BITS:
        raise ValueError("the blocks allow budgets from 0 to 2")

    def key(combo):
        parts = [F.shiftleft(F.shiftrightunsigned("fp", BLOCKS[k][0]).bitwiseAND(F.lit((1 << BLOCKS[k][1]) - 1)), sum(BLOCKS[x][1] for x in combo[:n])) for n, k in enumerate(combo)]
        return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])

    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(n).alias("combo"), key(c).alias("key")) for n, c in enumerate(COMBOS)])).alias("k"))
    return keyed.select("k.combo", "k.key", "fp").repartition("combo", "key").sortWithinPartitions("combo", "key").mapInArrow(_links(budget), "a long, b long")


def _grouped(docs: DataFrame, words: int, budget: int) -> DataFrame:
    """(doc_id, th, fp, root, component_id, n_copies) of every row; th tells the texts of a repeated doc_id apart."""
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    fps = cut(hashed.mapInArrow(_fingerprints(words), "doc_id long, th long, fp long"))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies")))
    comp = components(link_fingerprints(distinct, budget).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    of = distinct.join(comp, distinct.fp == comp.v, "left").select("fp", "first_id", "n_copies", F.coalesce("comp", "fp").alias("root"))
    first = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(cut(of.join(first, "root").select("fp", "root", "component_id", "n_copies")), "fp")


def simhash_groups(docs: DataFrame, words: int = 3, budget: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, n_copies.

    component_id is the smallest doc_id that is reachable over links of at most ``budget`` differing bits.  Copies share
    a fingerprint and are linked once.  n_copies: rows with this fingerprint.  Null and empty texts have fingerprint
    zero; rows with a null doc_id are grouped too but never name a group unless all its ids are null.  Repeated rows
    come back as often as they went in.  Other columns are not read.  An empty table gives an empty result.
    """
    return _grouped(docs, words, budget).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")


def drop_near_duplicates(docs: DataFrame, words: int = 3, budget: int = MAX_BITS) -> DataFrame:
    """One row of each SimHash group, with all its columns: that of the smallest doc_id (nulls last, then by a text hash).

    Of rows with one doc_id and text the one with the smallest hash of all its columns stays, so the result does not
    depend on the order of the rows.  Null and empty texts are one group.  An empty table stays empty.
    """
    names = docs.columns
    low = -(1 << 63)
    keys = ["__sh_null", "__sh_id", "__sh_th"]
    key = lambda th: [F.col("doc_id").isNull().alias(keys[0]), F.coalesce("doc_id", F.lit(low)).alias(keys[1]), th.alias(keys[2])]
    each = cut(_grouped(docs, words, budget).select("root", *key(F.col("th"))).groupBy("root", *keys).agg(F.count("*").alias("n")))
    best = each.groupBy("root").agg(F.min(F.struct(*keys, "n")).alias("k")).select("k.*")
    several = cut(best.where("n > 1").select(*keys))
    gone = cut(each.join(best, keys, "left_anti").select(*keys).unionByName(several))
    keyed = docs.select(*names, *key(F.xxhash64("text")))
    out = keyed.join(small_side(gone), keys, "left_anti").select(*names)  # few texts go: the others stay in place
    if several.isEmpty():
        return out
    one = keyed.join(small_side(several), keys, "left_semi").groupBy(*keys).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("__sh_row"))
    return out.unionByName(one.select("__sh_row.*"))
