"""Best-fit packing (operator 8): tokenised pieces, packed by a grouping genetic algorithm on islands."""

from __future__ import annotations

import os
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_batches
from .words import Hasher

CAPACITY = 2048
END = 0
#: Pieces that one island's solutions are about; the number of such groups follows the input.
GROUP = 4096
#: Each of a group's islands breeds so many generations in every epoch; elites migrate between epochs.
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 5, 8
#: How far the orders in which first solutions place their pieces are from falling lengths.
NOISE = 0.5
#: Islands that breed in one task (a twentieth of a second each in an epoch), up to so many tasks.
ISLES, TASKS = 8, 20_000
#: Sequences filled less than this are opened again and their pieces packed anew with those of other groups.
OPEN_BELOW = 0.97
#: Parts of texts, and ids of them, that a worker keeps.
WORDS, IDS = 1_000_000, 16_000_000
#: Characters of parts that are encoded as one text.
BATCH = 2_000

# The white space and the contractions of the tokenizer's splitting pattern.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
BLANK, WORD, NUMERAL, MARK = range(4)


@cache
def _kinds() -> np.ndarray:
    out = np.full(0x110000, MARK, np.int8)
    for k in range(0x110000):
        kind = unicodedata.category(chr(k))[0]
        out[k] = WORD if kind == "L" else NUMERAL if kind == "N" else MARK
    out[WHITE] = BLANK
    return out


@cache
def _unassigned() -> np.ndarray:
    """Code points without a category here, which the tokenizer's newer tables may take for letters or numerals."""
    return np.fromiter((unicodedata.category(chr(k)) == "Cn" for k in range(0x110000)), bool, 0x110000)


class Tokens:
    """Ids of whole texts, the same as the tokenizer's.

    Its splitting pattern (runs of letters, single numerals, runs of other marks, contractions; white space is dropped)
    is applied to arrays of code points; each distinct part is encoded once by the tokenizer and its ids are kept.  Texts
    that the tokenizer would normalise in other ways, that hold strings of its special tokens or code points which are
    unassigned here, and those whose parts turn out not to be the tokenizer's, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a part
        self.last[[k for w, k in vocab.items() if w.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.flat, self.used, self.known = np.zeros(1 << 16, np.uint32), 0, 0
        self.make_slots(1 << 16)

    def make_slots(self, n: int) -> None:
        """An empty table of ``n`` (a power of two) slots: a part's hash, where its ids begin, how many they are (0: free)."""
        self.hashes, self.begin, self.size = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each hash begin and how many they are (0: not known)."""
        slot = (h & np.uint64(len(self.size) - 1)).astype(np.int64)
        size = self.size[slot]
        todo = np.flatnonzero((self.hashes[slot] != h) & (size > 0))
        while len(todo):  # another part is there: look on
            slot[todo] = at = (slot[todo] + 1) & (len(self.size) - 1)
            size[todo] = self.size[at]
            todo = todo[(self.hashes[at] != h[todo]) & (size[todo] > 0)]
        return self.begin[slot], size

    def keep(self, h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Give distinct hashes that aren't known a slot each; at least half of all slots stay free."""
        self.known += len(h)
        if 2 * self.known > len(self.size):
            held = self.size > 0
            h, begin, size = (np.concatenate((old[held], new)) for old, new in ((self.hashes, h), (self.begin, begin), (self.size, size)))
            self.make_slots(1 << (2 * self.known).bit_length())
        slot, todo = (h & np.uint64(len(self.size) - 1)).astype(np.int64), np.arange(len(h))
        while len(todo):
            ready = todo[self.size[slot[todo]] == 0]
            self.hashes[slot[ready]] = h[ready]  # of several for one slot the last stays
            won = ready[self.hashes[slot[ready]] == h[ready]]
            self.begin[slot[won]], self.size[slot[won]] = begin[won], size[won]
            todo = todo[self.hashes[slot[todo]] != h[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.size) - 1)

    def plain(self, text: str) -> bool:
        if text.isascii():
            return not any(s in text for s in self.special)
        if _unassigned()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
            return False
        return unicodedata.is_normalized("NFC", text) and "\u03a3" not in text and "\u0130" not in text and not any(s in text for s in self.special)

    def learn(self, hashes: np.ndarray, parts: list[str]) -> bool:
        """Keep the ids of new parts; many are encoded as one text, in which the ids that end a part show where each ends.

        False, and nothing is kept, if the tokenizer splits them in another way."""
        size = np.cumsum([len(w) + 1 for w in parts])
        cuts = np.append(np.searchsorted(size, np.arange(0, size[-1], BATCH)), len(parts))
        joined = [" ".join(parts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(parts):
            return False
        total = len(ids)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat) + total, np.uint32)))
        self.flat[self.used : self.used + total] = ids
        first = np.concatenate(([0], ends[:-1]))
        self.keep(hashes, self.used + first, ends - first)
        self.used += total
        return True

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def parts(self, texts: list[str]):
        """(joined text, start, end, text of each part)."""
        joined = "\n".join([*texts, ""])
        x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[x]
        first = np.ones(len(x), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMERAL)
        lone = np.flatnonzero((x[:-1] == 39) & first[:-1] & (kind[1:] == WORD))  # an apostrophe alone before a letter
        for c in CONTRACTIONS:
            ok = lone[lone + len(c) < len(x)]
            for k, letter in enumerate(c[1:], 1):
                ok = ok[x[ok + k] == ord(letter)]
            first[ok + 1] = False
            first[ok + len(c)] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(x))
        real = kind[start] != BLANK
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        start, end = start[real], end[real]
        return joined, x, start, end, np.searchsorted(start, np.cumsum(size) - size)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.known > WORDS or self.used > IDS:
            self.reset()
        out: list = [None] * len(texts)
        plain = [self.plain(t) for t in texts]
        whole = [k for k, ok in enumerate(plain) if not ok]
        for k, ids in zip(whole, self.whole([texts[k] for k in whole]), strict=True):
            out[k] = ids
        rest = [k for k, ok in enumerate(plain) if ok]
        if not rest:
            return out
        joined, x, start, end, cuts = self.parts([texts[k].lower() for k in rest])
        h = Hasher(x)(start, end)
        begin, size = self.find(h)
        miss = np.flatnonzero(size == 0)
        if len(miss):
            new, at = np.unique(h[miss], return_index=True)
            at = miss[at]
            if not self.learn(new, [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]):
                for k, ids in zip(rest, self.whole([texts[k] for k in rest]), strict=True):
                    out[k] = ids
                return out
            begin[miss], size[miss] = self.find(h[miss])
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        cuts = ends[np.append(cuts, len(start))]
        for k, a, b in zip(rest, cuts[:-1], cuts[1:], strict=True):
            out[k] = ids[a:b]
        return out


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        tokens = Tokens(path)
        for piece, texts in text_batches(batches):
            rows, no, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(tokens.encode(texts)):
                data = np.append(ids, np.uint32(end)).astype("<u4").tobytes()
                n = len(data) // 4
                for p, a in enumerate(range(0, n, capacity)):
                    b = min(n, a + capacity)
                    rows.append(k)
                    no.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the id ``end``, cut every ``capacity`` ids."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packer:
    """Solutions of one group of lengths: an array that gives each piece its bin."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.least = -(-int(self.lengths.sum()) // capacity)
        self.rng = np.random.default_rng(seed)
        self.by_size = np.argsort(-self.lengths, kind="stable")

    def best_fit(self, order: np.ndarray, bins: np.ndarray, fill: list[int]) -> np.ndarray:
        """Place the pieces in ``order``, each into the fullest bin that still takes it, else into a new one."""
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for b, f in enumerate(fill):
            room[self.capacity - f].append(b)
            mask |= 1 << (self.capacity - f)
        for i, n in zip(order.tolist(), self.lengths[order].tolist(), strict=True):
            m = mask >> n
            if m:
                left = n + (m & -m).bit_length() - 1
                b = room[left].pop()
                if not room[left]:
                    mask ^= 1 << left
            else:
                b, left = len(fill), self.capacity
                fill.append(0)
            fill[b] += n
            left -= n
            if left:
                room[left].append(b)
                mask |= 1 << left
            bins[i] = b
        return bins

    def fresh(self, noise: float) -> np.ndarray:
        order = self.by_size if not noise else np.argsort(-self.lengths * (1 + noise * self.rng.standard_normal(len(self.lengths))), kind="stable")
        return self.best_fit(order, np.full(len(self.lengths), -1, np.int64), [])

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.lengths).astype(np.int64)

    def worth(self, bins: np.ndarray) -> tuple[int, float]:
        fill = self.fills(bins)
        return -len(fill), float(np.square(fill / self.capacity).sum())

    def cross(self, mine: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Inject well-filled bins of ``other`` whole; bins of ``mine`` that share a piece with them are dissolved and
        the displaced pieces go, longest first, to where they fit best."""
        fill = self.fills(other)
        well = np.flatnonzero(fill >= min(max(0.98 * self.capacity, np.quantile(fill, 0.6)), fill.max()))
        chosen = np.zeros(len(fill), bool)
        chosen[self.rng.choice(well, max(1, len(well) // 2), replace=False)] = True
        inside = chosen[other]
        gone = np.zeros(mine.max() + 1, bool)
        gone[mine[inside]] = True
        worst = np.argsort(self.fills(mine))[: 1 + len(gone) // 50]  # the emptiest bins are dissolved too
        gone[worst] = True
        keep = ~gone[mine] & ~inside
        child = np.full(len(mine), -1, np.int64)
        names = np.full(len(chosen) + len(gone), -1, np.int64)
        group = np.where(inside, other, np.where(keep, mine + len(chosen), -1))
        held = group >= 0
        used = np.unique(group[held])
        names[used] = np.arange(len(used))
        child[held] = names[group[held]]
        loose = self.by_size[~held[self.by_size]]
        fill = np.bincount(child[held], self.lengths[held], len(used)).astype(np.int64).tolist()
        return self.best_fit(loose, child, fill)

    def evolve(self, start: list[np.ndarray], population: int, generations: int, last: bool = False) -> tuple[np.ndarray, int, int]:
        """(elite, its generation, bins of the best first solution) after ``generations`` of crossover.

        The pool is ``start`` and randomised solutions; in the ``last`` epoch the best fit of falling lengths joins, so
        that no group ends with more bins than that.  The generation is 0 for a solution that no crossover made."""
        first = [*start, *(self.fresh(NOISE * (k + 1)) for k in range(max(population - len(start), 2)))]
        pool = [(self.worth(x), 0, x) for x in first]
        begun = -max(pool, key=lambda p: p[0])[0][0]
        if last:
            plain = self.fresh(0.0)
            pool.append((self.worth(plain), 0, plain))
        for g in range(1, generations + 1):
            a, b = (max((pool[int(k)] for k in self.rng.integers(0, len(pool), 2)), key=lambda p: p[0])[2] for _ in range(2))
            for child in (self.cross(a, b), self.cross(max(pool, key=lambda p: p[0])[2], b)):
                pool.append((self.worth(child), g, child))
            pool = sorted(pool, key=lambda p: (p[0], p[1]), reverse=True)[:population]
        best = max(pool, key=lambda p: (p[0], p[1]))
        return best[2], best[1], begun


def _evolve(capacity: int, epoch: int):
    """(grp, island, lengths[, elite, guest, born, guest_born]) -> the same with the island's elite, its bins and history."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                seed = (row["grp"] * 7919 + row["island"] * 104729 + epoch) & 0x7FFFFFFF
                packer = Packer(np.array(row["lengths"]), capacity, seed)
                start = [np.array(x, np.int64) for x in (row.get("elite"), row.get("guest")) if x]
                best, g, begun = packer.evolve(start, POPULATION, GENERATIONS, epoch == EPOCHS - 1)
                if g:
                    g += epoch * GENERATIONS
                elif epoch:  # it came in as one of the two elites, or is the best fit
                    same = [row[k] for k, x in zip(("born", "guest_born"), start, strict=True) if (x == best).all()]
                    g = max(same, default=0)
                out.append((row["grp"], row["island"], best, -packer.worth(best)[0], g, row.get("begun") or begun))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array([x.astype(np.int32) for x in cols[2]], pa.list_(pa.int32())), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int64())], names=["grp", "island", "elite", "bins", "born", "begun"])

    return run


def _islands(items: DataFrame, capacity: int, group: int, salt: int) -> DataFrame:
    """(key, length) -> (key, length, grp, bin, born) by the genetic algorithm, each group on ISLANDS islands."""
    n = items.count()
    groups = max(1, -(-n // group))
    dealt = items.select("key", "length", F.pmod(F.xxhash64(F.lit(salt), "key"), F.lit(groups)).alias("grp"))
    packed = dealt.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("key", "length"))).alias("x"))
    packed = cut(packed.select("grp", F.col("x.key").alias("keys"), F.col("x.length").alias("lengths")))
    kind = "grp long, island int, elite array<int>, bins long, born int, begun long"
    # by number: islands are few bytes but much work, and partitions that are merged by bytes would breed one after another
    tasks = min(-(-groups * ISLANDS // ISLES), TASKS)
    isles = packed.select("grp", "lengths", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island")).repartition(tasks, "grp", "island")
    state = cut(isles.mapInArrow(_evolve(capacity, 0), kind))
    for epoch in range(1, EPOCHS):  # each island's elite goes on to the next island of its group
        guests = state.select("grp", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("elite").alias("guest"), F.col("born").alias("guest_born"))
        both = state.join(guests, ["grp", "island"]).join(packed.select("grp", "lengths"), "grp")
        state = cut(both.select("grp", "island", "lengths", "elite", "guest", "born", "guest_born", "begun").repartition(tasks, "grp", "island").mapInArrow(_evolve(capacity, epoch), kind))
    best = state.groupBy("grp").agg(F.min_by(F.struct("elite", "born"), F.struct("bins", "island")).alias("b"))
    rows = packed.join(best, "grp").select("grp", "b.born", F.explode(F.arrays_zip("keys", "lengths", F.col("b.elite").alias("elite"))).alias("r"))
    return rows.select(F.col("r.keys").alias("key"), F.col("r.lengths").alias("length"), "grp", F.col("r.elite").alias("bin"), "born")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, generation): the pieces of all texts in sequences.

    A text is its ids by the tokenizer at ``path`` (no special tokens), then the id ``end``; a null text counts as empty
    and is one id.  Texts of over ``capacity`` ids are cut, nothing else is.  Full pieces are sequences of their own.
    The rest are dealt by hash into groups of about ``group`` pieces; in each, islands start from randomised solutions
    and breed GENERATIONS generations in each of EPOCHS epochs: crossover injects whole well-filled bins, removes what is
    twice and best-fits displaced pieces, and between epochs elites migrate to the next island.  The best-fit solution
    joins the last epoch, so a group never has more bins than that.  Bins that are left open (under OPEN_BELOW) are
    dissolved and their pieces packed once more together, over all groups.  generation: the one whose crossover made the
    solution that a piece's sequence is from, counted over epochs; 0 if none did, null for full pieces.
    Repeated rows and null doc_ids are packed like others.  An empty table gives an empty result.
    """
    own = cut(pieces(docs, path, capacity, end).withColumn("key", F.monotonically_increasing_id()))
    full = own.where(F.col("length") == capacity).select("key", (F.col("key") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(None).cast("int").alias("generation"))
    items = own.where(F.col("length") < capacity).select("key", "length")
    first = cut(_islands(items, capacity, group, 1))
    fill = first.groupBy("grp", "bin").agg(F.sum("length").alias("fill"), F.min("key").alias("low"))
    open_bin = F.col("fill") < int(OPEN_BELOW * capacity)
    named = cut(first.join(fill, ["grp", "bin"]).select("key", "length", open_bin.alias("open"), (F.col("low") * 4 + 1).alias("sequence_id"), "born"))
    again = cut(_islands(named.where("open").select("key", "length"), capacity, group, 2))
    low = again.groupBy("grp", "bin").agg((F.min("key") * 4 + 2).alias("sequence_id"))
    placed = named.where("not open").select("key", "length", "sequence_id", "born").unionByName(again.join(low, ["grp", "bin"]).select("key", "length", "sequence_id", "born"))
    # a sequence holds capacity pieces at most, so this collects bounded lists
    laid = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("key", "length", "born"))).alias("x"))
    sums = F.transform("x", lambda v, i: F.struct(v.key.alias("key"), F.aggregate(F.slice("x", 1, i), F.lit(0).cast("long"), lambda s, w: s + w.length).alias("offset"), v.born.alias("generation")))
    laid = laid.select("sequence_id", F.explode(sums).alias("r")).select("r.key", "sequence_id", "r.offset", "r.generation")
    return own.join(full.unionByName(laid), "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "generation")
