"""Benchmark decontamination (operator 1): typed templates, a hash join of template windows, slot consistency."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, small_side, text_batches
from .words import DIGIT, LETTER, SPACE, UPPER, Hasher, Texts, word_hash

WINDOW = 5
COVERAGE = 0.8
#: Bits of the map of window hashes that every worker gets: 8 MB, whatever the size of the benchmark.
MAP_BITS = 26

LITERAL, NUMBER, NAME, UNIT = range(4)
#: What stands as a word in a window: literals; literals and names; everything.
FEW, NAMES, ALL = range(3)
#: Document tokens of a block in which an item is aligned, for items of up to half as many tokens.
BLOCK = 1024
# Spelled numbers and common units of measure.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet yard yards g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces l ml liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kmh kph hz khz mhz ghz watt watts volt volts joule joules".split())
EDGE = ".,;:!?\"'()[]{}<>«»“”‘’…-–—*_#|"
CLOSERS = "\"')]}»”’"
STOPS = ".!?:"
IN_NUMBERS = "+-$€£.,:/%"


def _has(x: np.ndarray, chars: str) -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in chars]] = True
    return table[x]


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.clip(np.searchsorted(table, h), 0, len(table) - 1)] == h


class Templates:
    """Typed tokens and window hashes of many texts at once."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        rng = np.random.default_rng(41)
        self.place = rng.integers(1, 1 << 63, window, dtype=np.uint64) | np.uint64(1)
        self.typed = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.lower = np.arange(0x110000, dtype=np.uint32)
        for k in range(0x110000):
            c = chr(k)
            if c.isupper() and len(low := c.lower()) == 1:
                self.lower[k] = ord(low)
        self.spelled, self.units = (np.array(sorted(map(word_hash, ws)), np.uint64) for ws in (NUMBER_WORDS, UNITS))

    def tokens(self, texts: list[str]):
        """(raw, kind, own, start): word hashes, types, the text of each token, and each text's first token."""
        t = Texts(texts)
        n = len(t.x)
        here = np.arange(n)
        outer = _has(t.x, EDGE) | (t.kind == SPACE)
        after = np.minimum.accumulate(np.where(outer, n, here)[::-1])[::-1]
        before = np.maximum.accumulate(np.where(outer, -1, here))
        start, end = after[t.start], before[t.end - 1] + 1  # the word without punctuation around it
        real = np.flatnonzero(start < t.end)
        own, a, b = t.own[real], start[real], end[real]
        raw = Hasher(self.lower[t.x])(a, b)

        def count(mask):
            c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
            return c[b] - c[a]

        letter = (t.kind & 7) == LETTER
        digits, letters, size = count(t.kind == DIGIT), count(letter), b - a
        numeral = (digits > 0) & (digits + count(_has(t.x, IN_NUMBERS)) + letters == size)
        numeral &= (letters == 0) | ((letters <= 4) & letter[b - 1] & ~letter[a])  # 5, 3.5%, 12:30, 5km
        kind = np.where(numeral | _among(raw, self.spelled), NUMBER, np.where(_among(raw, self.units), UNIT, LITERAL)).astype(np.int8)
        # a capital inside a sentence makes a name
        inner = np.maximum.accumulate(np.where(_has(t.x, CLOSERS), -1, here))
        stop = _has(t.x[inner[t.end - 1]], STOPS)
        line = np.concatenate(([0], np.cumsum(t.x == 10)))
        fresh = np.ones(len(t.start), bool)
        fresh[1:] = stop[:-1] | (line[t.start[1:]] > line[t.end[:-1]])
        name = (kind == LITERAL) & (t.kind[a] == LETTER + UPPER) & (letters == size) & ~fresh[real]
        kind[name] = NAME
        return raw, kind, own, np.searchsorted(own, np.arange(len(texts) + 1))

    def _hashes(self, code: np.ndarray) -> np.ndarray:
        n = len(code) - self.window + 1
        with np.errstate(over="ignore"):
            return mix(sum((code[k : k + n] * self.place[k] for k in range(self.window)), np.zeros(n, np.uint64)))

    def windows(self, raw, kind, own) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all windows, where they begin, and of each what stands as a word in it: FEW, NAMES or ALL.

        A window with a name is given twice, with the name as a slot and as a word, so that it also meets texts in which
        capitals say nothing.  A window without a literal is one of plain words: slots alone are no evidence, and would
        be the same in every table of numbers."""
        n = len(raw) - self.window + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8)
        at = np.flatnonzero(own[:n] == own[self.window - 1 :])
        among = lambda mask: (c := np.concatenate(([0], np.cumsum(mask))))[at + self.window] - c[at]
        literals, names = among(kind == LITERAL), among(kind == NAME)
        parts = []
        for plain, here in ((FEW, at[literals > 0]), (NAMES, at[(names > 0) & (literals + names > 0)]), (ALL, at[literals + names == 0])):
            if len(here):
                word = (kind == LITERAL) | ((kind == NAME) & (plain != FEW)) | (plain == ALL)
                parts.append((self._hashes(np.where(word, raw, self.typed[kind]))[here], here, np.full(len(here), plain, np.int8)))
        return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, np.uint64), at[:0], np.zeros(0, np.int8))


    def short(self, raw, own, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words, none as a slot, and where they begin; ``size`` is under the window's."""
        n = max(len(raw) - size + 1, 0)
        at = np.flatnonzero(own[:n] == own[len(raw) - n :])
        with np.errstate(over="ignore"):
            return mix(sum((raw[at + k] * self.place[k] for k in range(size)), np.full(len(at), size, np.uint64))), at


def _window_rows(window: int, seen=None, with_size: bool = False, sizes=()):
    """(id, th, text) -> (id, th, pos, wh, slots[, size]): the windows, only those in the map ``seen`` if it is given.

    slots: the raw hash of each slot's word, 0 for a literal.  ``sizes``: also runs of so many plain words, of items
    (``with_size``) only those that are the whole item."""

    def run(batches):
        made = Templates(window)
        bits = None if seen is None else np.frombuffer(seen.value, np.uint8)
        for piece, texts in text_batches(batches):
            raw, kind, own, start = made.tokens(texts)
            h, at, plain = made.windows(raw, kind, own)
            slot = np.where(kind == LITERAL, np.uint64(0), raw).view(np.int64)
            count = np.diff(start)
            for size in (window, *sizes):
                if size != window:
                    h, at = made.short(raw, own, size)
                    if with_size:
                        h, at = h[count[own[at]] == size], at[count[own[at]] == size]
                if bits is not None:
                    k = h >> np.uint64(64 - MAP_BITS)
                    hit = (bits[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    h, at, plain = h[hit], at[hit], plain[hit] if size == window else plain
                if not len(at):
                    continue
                here = at[:, None] + np.arange(size)
                slots = np.where((plain[:, None] == ALL) | ((plain[:, None] == NAMES) & (kind[here] == NAME)), 0, slot[here]) if size == window else np.zeros(here.shape, np.int64)
                of = own[at]
                cols = [piece.column(0).take(pa.array(of)), piece.column(1).take(pa.array(of)), pa.array(at - start[of]), pa.array(h.view(np.int64))]
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(slots.ravel())))
                if with_size:
                    cols.append(pa.array(count[of]))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "th", "pos", "wh", "slots", "size"][: len(cols)])

    return run


def _map_of(windows: DataFrame):
    """A bit for each window hash's highest MAP_BITS bits, made in segments of 8 kB and sent to all workers."""
    bucket = F.shiftrightunsigned("wh", 64 - MAP_BITS)
    segments = windows.select(F.shiftright(bucket, 16).alias("seg"), bucket.bitwiseAND(F.lit(65535)).cast("int").alias("b")).distinct().groupBy("seg").agg(F.collect_list("b").alias("bs"))

    def pack(batches):
        for batch in batches:
            out = []
            for bs in batch.column(1).to_pylist():
                x = np.zeros(65536, bool)
                x[bs] = True
                out.append(np.packbits(x, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["seg", "bits"])

    full = bytearray(1 << (MAP_BITS - 3))
    for seg, bits in segments.mapInArrow(pack, "seg long, bits binary").collect():  # 1024 rows of 8 kB at most
        full[seg * 8192 : seg * 8192 + 8192] = bits
    return windows.sparkSession.sparkContext.broadcast(bytes(full))


def match(size: int, found: list[tuple], window: int = WINDOW) -> tuple[float, int, int]:
    """Best (coverage, first, last document token) among alignments of an item of ``size`` tokens.

    found: (document position, item position, document slots, item slots) of equal template windows.  Windows that lie
    on nearly one diagonal make an alignment.  In it an item's slot value must stand for one value of the document, and a
    document's value for one of the item's: windows that contradict what most windows say are left out.  coverage: the item's tokens that the other
    windows cover, as a share; an alignment needs ``window`` literal tokens.  A whole copy, with the item's own value in
    every slot, needs none.
    """
    found = sorted(set(found), key=lambda m: (m[0] - m[1], m[0]))
    slack, best = max(2, size // 5), (0.0, 0, 0)
    a, last = 0, -1
    for b in range(len(found)):
        while found[b][0] - found[b][1] - (found[a][0] - found[a][1]) > slack:
            a += 1
        if b + 1 < len(found) and found[b + 1][0] - found[b + 1][1] - (found[a][0] - found[a][1]) <= slack:
            continue  # the next one belongs to this alignment too
        if a <= last and b <= last:
            continue
        last = b
        part = found[a : b + 1]
        if len({m[1] for m in part}) * window < best[0] * size:
            continue
        votes: dict[int, Counter] = defaultdict(Counter)
        back: dict[int, Counter] = defaultdict(Counter)
        for _, _, mine, its in part:
            for x, y in zip(mine, its, strict=True):
                if y:
                    votes[y][x] += 1
                    back[x][y] += 1
        says, said = ({y: min(c, key=lambda x: (-c[x], x)) for y, c in v.items()} for v in (votes, back))
        good = [m for m in part if all(not y or (says[y] == x and said[x] == y) for x, y in zip(m[2], m[3], strict=True))]
        cover, literal = set(), set()
        for m in good:
            cover.update(range(m[1], m[1] + window))
            literal.update(m[1] + k for k, y in enumerate(m[3]) if not y)
        if good and len(literal) >= window:
            best = max(best, (len(cover) / size, -min(m[0] for m in good), max(m[0] for m in good) + window - 1))
    if best[0] < 1:
        same: dict[int, set] = defaultdict(set)
        for d, i, mine, its in found:
            if mine == its:
                same[d - i].add(i)
        for d in sorted(same):
            if len(same[d]) == size - window + 1:
                return 1.0, d, d + size - 1
    return best[0], -best[1], best[2]


def _verify(window: int, coverage: float):
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                got, first, last = match(row["size"], [(m["dpos"], m["ipos"], tuple(m["dslots"]), tuple(m["islots"])) for m in row["found"]], min(window, row["size"]))
                if got >= coverage:
                    out.append((row["id"], row["th"], row["item_id"], got, first, last))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["id", "th", "item_id", "coverage", "first_word", "last_word"])

    return run


def _found(docs: DataFrame, benchmark: DataFrame, window: int, coverage: float) -> DataFrame:
    items = benchmark.select(F.col("item_id").alias("id"), F.xxhash64("text").alias("th"), "text").distinct()
    kind = "id long, th long, pos long, wh long, slots array<long>"
    mine = cut(items.mapInArrow(_window_rows(window, with_size=True, sizes=range(1, window)), f"{kind}, size long").select(F.col("id").alias("item_id"), F.col("th").alias("ith"), F.col("pos").alias("ipos"), "wh", F.col("slots").alias("islots"), "size"))
    seen = _map_of(mine)
    short = sorted(r["size"] for r in mine.where(F.col("size") < window).select("size").distinct().collect())  # window - 1 at most
    theirs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_window_rows(window, seen, sizes=short), kind)
    both = theirs.join(small_side(mine), "wh")
    pair = F.struct(F.col("pos").alias("dpos"), "ipos", F.col("slots").alias("dslots"), "islots")
    # an alignment, of size + slack tokens at most, lies whole in one of the blocks, which overlap by half
    half = F.greatest(F.lit(BLOCK), 2 * F.col("size"))
    both = both.withColumn("block", F.explode(F.filter(F.array(F.floor(F.col("pos") / half), F.floor(F.col("pos") / half) - 1), lambda b: b >= 0)))
    grouped = both.groupBy(F.coalesce("id", F.lit(-(1 << 63))).alias("k"), F.col("id").isNull().alias("nul"), "th", "item_id", "ith", "size", "block").agg(F.collect_set(pair).alias("found"))
    likely = grouped.where(F.size(F.array_distinct(F.col("found.ipos"))) * F.least(F.lit(window), "size") >= F.col("size") * coverage)
    named = likely.select(F.when(~F.col("nul"), F.col("k")).alias("id"), "th", "item_id", "size", "found")
    return named.mapInArrow(_verify(window, coverage), "id long, th long, item_id long, coverage double, first_word long, last_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, first_word, last_word): the benchmark items that documents hold, also re-parameterised.

    A text is lower-cased, stripped of punctuation, and its numbers, names (capitalised inside a sentence) and units
    become typed placeholders (windows with names are also matched word by word, windows of slots alone only so).
    Windows of ``window`` tokens are hash-joined; a pair is reported if windows with consistent slots on one alignment
    cover at least ``coverage`` of the item's tokens.  An alignment needs ``window`` tokens that are no slots, or else be
    a whole copy with the item's own slot values.  Items of fewer than ``window`` tokens match copies of all their words
    (so an item of one word matches every text with this word); null and empty texts never match; a null doc_id or
    item_id is reported as null.  Identical rows are reported once, of a document's alignments with an item the first one
    of the highest coverage.  Other columns aren't read.  Empty tables give an empty result.  Long documents are aligned
    in blocks of tokens.
    """
    best = F.max(F.struct("coverage", (-F.col("first_word")).alias("f"), F.col("last_word").alias("l"))).alias("b")
    return _found(docs, benchmark, window, coverage).groupBy(F.col("id").alias("doc_id"), "item_id").agg(best).select("doc_id", "item_id", "b.coverage", (-F.col("b.f")).alias("first_word"), F.col("b.l").alias("last_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item (see ``contaminated``), all columns and rows else unchanged."""
    low = -(1 << 63)
    keys = ["__dc_id", "__dc_null", "__dc_th"]
    bad = cut(_found(docs, benchmark, window, coverage).select(F.coalesce("id", F.lit(low)).alias("__dc_id"), F.col("id").isNull().alias("__dc_null"), F.col("th").alias("__dc_th")).distinct())
    keyed = docs.withColumns({"__dc_id": F.coalesce("doc_id", F.lit(low)), "__dc_null": F.col("doc_id").isNull(), "__dc_th": F.xxhash64("text")})
    return keyed.join(small_side(bad), keys, "left_anti").select(*docs.columns)
