"""Operators against brute force, round trips and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import xxhash
from graphloam.llm import chat, decontaminate, line_dedup, lm_score, packing, passage_dedup, queries, rules, simhash

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def read(spark, name, sf=SMALL):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(values):
    parent = list(range(len(values)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(values))]


def test_simhash_matches_brute_force(spark):
    d = read(spark, "documents").select("doc_id", "text")
    rows = sorted(d.collect())
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", rows[g].doc_id) for r, f, g in zip(rows, fps, brute_groups(fps), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(d).collect()}
    assert got == want


def test_trie_join_links_all_near_fingerprints(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(20):
        base = rng.getrandbits(64)
        for _ in range(40):
            v = base
            for _ in range(rng.randrange(5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"))
    comp = {r.v: r.comp for r in simhash.components(links.selectExpr("a as src", "b as dst")).collect()}
    groups = brute_groups(values)
    low = {}
    for v, g in zip(signed, groups, strict=True):
        low[g] = min(low.get(g, v), v)
    assert all(comp.get(v, v) == low[g] for v, g in zip(signed, groups, strict=True))


def test_trie_join_splits_large_frontiers(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 16)
    rng = np.random.default_rng(1)
    v = np.unique(rng.integers(0, 1 << 12, 600, dtype=np.uint64))
    pairs = {(int(a), int(b)) for i, j in simhash.trie_links(v, np.zeros(len(v)), np.arange(63, -1, -1)) for a, b in zip(i, j, strict=True)}
    assert {tuple(sorted(p)) for p in pairs} == {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if (int(v[a]) ^ int(v[b])).bit_count() <= 2}


def test_near_duplicates_keep_one_row_of_each_group(spark):
    rows = [(1, ""), (None, None), (2, "a b c d"), (2, "a b c d"), (None, "zz yy xx"), (3, "A  b C d"), (2, "qq")]
    got = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (2, "a b c d"), (None, "zz yy xx"), (2, "qq")], key=str)


def brute_line_dedup(rows, n=3):
    first, cut = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = text.split("\n")
        for k in range(max(1, len(lines) - n + 1)):
            w = tuple(lines[k : k + n])
            if not WORDS.search(" ".join(w)):
                continue
            if w in first:
                cut.setdefault(doc, set()).update(range(k, k + n))
            first.setdefault(w, (doc, k))
    return {doc: "\n".join(x for k, x in enumerate(text.split("\n")) if k not in cut.get(doc, ())) for doc, text in rows}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, "\n".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 9)))) for k in range(150)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert got == brute_line_dedup(rows)


def brute_passages(rows, n):
    """The words that stay of each document."""
    first, gone = {}, {}
    for doc, text in sorted(rows):
        w = WORDS.findall(text)
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k : k + n]), (doc, k)) != (doc, k):
                gone.setdefault(doc, set()).update(range(k, k + n))
    return {doc: [x for k, x in enumerate(WORDS.findall(text)) if k not in gone.get(doc, ())] for doc, text in rows}


@pytest.mark.parametrize("n", [2, 5, 6])
def test_passage_dedup_matches_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(k, "".join(rng.choice("abc") + rng.choice([" ", "\n", "  "]) for _ in range(rng.randrange(40)))) for k in range(60)]
    got = {r.doc_id: WORDS.findall(r.text) for r in passage_dedup.passage_dedup(docs_of(spark, rows), n).collect()}
    assert got == brute_passages(rows, n)


def test_passages_of_fifty_words_go_whatever_lines_they_stand_in(spark):
    p = [f"w{k}" for k in range(60)]
    one, two = " ".join(p), " ".join(p[:30]) + "\n" + " ".join(p[30:])
    rows = [(1, f"a b {one} c\nd"), (2, f"x\n{one}\ny"), (3, f"u {one} v"), (4, two), (5, f"q\n{two} r\ns"), (6, " ".join(p[:49])), (7, None)]
    docs = docs_of(spark, rows)
    report = {r.doc_id: r for r in passage_dedup.dedup_report(docs).collect()}
    got = {k: r.text for k, r in report.items()}
    assert got == {1: rows[0][1], 2: "x\ny", 3: "u v", 4: "", 5: "q\nr\ns", 6: rows[5][1], 7: None}
    assert all(r.n_removed == 0 and r.n_cut == len(rows[k - 1][1] or "") - len(r.text or "") for k, r in report.items())
    out = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, SMALL).collect()}
    assert out == got


def test_decontamination_finds_reparameterised_questions(spark):
    item = "A farmer named Alice has 12 apples and sells 5 of them to Bob for 3 dollars before lunch."
    changed = "Some page said: a farmer named Carol has 40 apples and sells 7 of them to Dave for 9 euros before lunch. The end."
    inconsistent_item = "The number 4 plus 4 plus 4 gives the number 4 when 4 is taken from 4 twice over."
    inconsistent = "The number 1 plus 2 plus 3 gives the number 5 when 6 is taken from 7 twice over."
    docs = docs_of(spark, [(1, changed), (2, "a farmer named something else entirely sells nothing here at all"), (3, item.lower()), (4, inconsistent), (5, None), (6, ""), (3, item.lower()), (None, item)])
    bench = spark.createDataFrame([(7, item), (8, inconsistent_item), (9, "too short"), (10, None)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()), key=str)
    assert got == [(1, 7), (3, 7), (None, 7)]
    kept = decontaminate.decontaminate(docs.selectExpr("*", "doc_id as pos", "text as wh"), bench)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 4, 5, 6]
    assert kept.columns == ["doc_id", "text", "pos", "wh"]


def test_decontamination_finds_copies_of_short_and_number_heavy_items(spark):
    items = ["What is 17 times 24 plus 9?", "Compute 12 + 35 - 7", "3 + 4 = 7", "Name two primes"]
    other = ["What is 18 times 25 plus 8?", "Compute 13 + 36 - 8", "3 + 4 = 8", "Name three primes"]
    docs = docs_of(spark, [(k, f"Here it says: {t} And so on it goes.") for k, t in enumerate(items)] + [(10 + k, f"Here it says: {t} And so on it goes.") for k, t in enumerate(other)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.coverage, r.first_word) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(k, k, 1.0, 3) for k in range(4)}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {10, 11, 12, 13}


def brute_contaminated(docs, items, window=decontaminate.WINDOW, coverage=decontaminate.COVERAGE):
    """Templates and slots token by token: an item is found where windows with one-to-one slot values cover it."""
    edge = decontaminate.EDGE + " \t\n"

    def tokens(text):
        out, fresh = [], True
        for m in re.finditer(r"\S+", text):
            raw = m.group().strip(edge)
            end = re.sub(r"[%s]+$" % re.escape(decontaminate.CLOSERS), "", m.group())
            if "\n" in text[: m.start()][len(text[: m.start()].rstrip()) :]:
                fresh = True
            if raw:
                low = raw.lower()
                if re.fullmatch(r"[-+$€£.,:/%\d]*\d[-+$€£.,:/%\d]*(?:[^\W\d_]{1,4})?", low) or low in decontaminate.NUMBER_WORDS:
                    kind = "number"
                elif low in decontaminate.UNITS:
                    kind = "unit"
                else:
                    kind = "name" if raw.isalpha() and raw[0].isupper() and not fresh else None
                out.append((low, kind))
            fresh = end[-1:] in decontaminate.STOPS and bool(end)
        return out

    def windows(ts, k):
        part = ts[k : k + window]
        yield tuple((kind or low, 0 if kind is None else low) for low, kind in part)
        yield tuple((low, 0) if kind in (None, "name") else (kind, low) for low, kind in part)

    found = set()
    for i, item in items:
        its = tokens(item or "")
        if len(its) < window:
            continue
        for d, text in docs:
            mine = tokens(text or "")
            pairs = []
            for a in range(len(mine) - window + 1):
                for b in range(len(its) - window + 1):
                    for x, y in zip(windows(mine, a), windows(its, b), strict=True):
                        if [p[0] for p in x] == [p[0] for p in y] and any(p[1] == 0 for p in y):
                            pairs.append((a, b, [p[1] for p in x], [p[1] for p in y]))
            slack = max(2, len(its) // 5)
            for low in {a - b for a, b, _, _ in pairs}:
                part = [p for p in pairs if low <= p[0] - p[1] <= low + slack]
                says, said = {}, {}
                for _, _, x, y in part:
                    for p, q in zip(x, y, strict=True):
                        if q:
                            says.setdefault(q, Counter())[p] += 1
                            said.setdefault(p, Counter())[q] += 1
                ok = [p for p in part if all(not q or (says[q].most_common(1)[0][0] == v and said[v].most_common(1)[0][0] == q) for v, q in zip(p[2], p[3], strict=True))]
                cover = {p[1] + k for p in ok for k in range(window)}
                literal = {p[1] + k for p in ok for k in range(window) if not p[3][k]}
                if len(literal) >= window and len(cover) >= coverage * len(its):
                    found.add((d, i))
    return found


def test_decontamination_matches_brute_force_on_templates(spark):
    rng = random.Random(6)
    names = ["Alice", "Bob", "Carol", "Dave", "Erin", "Frank"]
    plot = ["The baker {n} made {a} rolls and gave {b} of them to {m} who ate {c} kg before noon .", "A train with {a} seats leaves {n} and carries {b} people to {m} while {c} miles remain to go .", "If {n} pays {a} dollars and {m} pays {b} dollars for {c} boxes then each box costs how much ?"]
    fill = "some other words that come before and after it in a longer page of text".split()

    def told(p, same=None):
        n, m = rng.sample(names, 2)
        a, b, c = (same,) * 3 if same else rng.sample(range(2, 99), 3)
        return p.format(n=n, m=m, a=a, b=b, c=c)

    items = [(k, told(p)) for k, p in enumerate(plot)]
    docs = []
    for d in range(60):
        p = told(rng.choice(plot), rng.choice([None, None, 7]))
        words = p.split()
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = rng.choice([*fill, "12", "Bob"])
        docs.append((d, " ".join(rng.choices(fill, k=rng.randrange(0, 30)) + words + rng.choices(fill, k=rng.randrange(0, 30)))))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_contaminated(docs, items)
    assert got == want and 12 < len(got) < 60


def test_tables_of_numbers_and_long_documents(spark):
    table = " ".join(str(k * k % 1000) for k in range(3000))
    item = "Sort these values 5 17 29 41 53 61 73 89 97 11 13 and name the third one of them"
    numbers = "3 1 4 1 5 9 2 6 5 3 5"
    docs = docs_of(spark, [(1, table), (2, f"{table} {item} {table}"), (3, f"{table} {numbers} {table} {numbers}"), (4, f"word {item.replace('29', '30').replace('Sort', 'Order')} word")])
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, spark.createDataFrame([(1, item), (2, numbers)], "item_id long, text string")).collect()}
    assert set(got) == {(2, 1), (3, 2)} | ({(4, 1)} & set(got))
    assert (got[2, 1].first_word, got[2, 1].last_word, got[2, 1].coverage) == (3000, 3000 + len(item.split()) - 1, 1.0)
    assert (got[3, 2].first_word, got[3, 2].last_word) == (3000, 3010)
    own = decontaminate._found(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), 5, 0.8)
    assert {r.id for r in own.collect()} <= {2, 4}


def test_decontamination_matches_a_search_for_whole_items(spark):
    docs, items = read(spark, "documents", "/root/testdata/sf0.01").collect(), read(spark, "benchmark").collect()
    plain = lambda t: " ".join(WORDS.findall(t))
    texts = [(d.doc_id, plain(d.text)) for d in docs]
    want = {(k, i.item_id) for i in items for k, t in texts if plain(i.text) in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(read(spark, "documents", "/root/testdata/sf0.01"), read(spark, "benchmark")).collect()}
    assert want and want <= got
    for doc, item in got - want:  # edited copies: most of the item's words are there in order
        words = plain(next(i.text for i in items if i.item_id == item)).lower().split()
        text = dict(texts)[doc].lower()
        assert sum(" ".join(words[k : k + 3]) in text for k in range(len(words) - 2)) >= 0.7 * (len(words) - 2)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_tokens_are_the_tokenizers(spark, tokenizer):
    hard = ["don't you'll 'sure ''s they're ''ll I'D", "Café café ΣΑΣ İstanbul", "a<|endoftext|>b <|startoftext|>", "12³ ½ x2y ₀", "", "  　\x1c \x85 z", "日本語 한국어 ñandú ", "🙂🙂 a🙂b", "'s 's' 't", "퟿�"]
    texts = hard + [r.text for r in read(spark, "documents").limit(100).collect()]
    t = packing.Tokens(queries.tokenizer_path())
    for _ in range(2):
        got = t.encode(texts)
        assert [x.tolist() for x in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_tokens_of_every_code_point_are_the_tokenizers(tokenizer):
    import unicodedata

    t = packing.Tokens(queries.tokenizer_path())
    known = [chr(k) for k in range(0x110000) if unicodedata.category(chr(k)) not in ("Cn", "Cs", "Co")]
    assert not any(t.plain(chr(k)) for k in range(0x110000) if unicodedata.category(chr(k)) == "Cn")
    odd = ["ab\U000105c0cd", "hello a\u1c89b world", "x \u1c8a\u1c8a!", "\ua7cb\ua7cb", "\ue000 a\ue000b"]
    for form in ("{0}", "{0}{0}", "ab{0}cd", "1 {0}2"):
        texts = odd + [form.format(c) for c in known]
        for k in range(0, len(texts), 20_000):
            part = texts[k : k + 20_000]
            want = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            assert [x.tolist() for x in t.encode(part)] == want


def test_texts_are_encoded_whole_when_parts_differ(tokenizer, monkeypatch):
    t = packing.Tokens(queries.tokenizer_path())
    t.last[:] = False  # as if no id ended a part
    assert [x.tolist() for x in t.encode(["one two", "three"])] == [e.ids for e in tokenizer.encode_batch(["one two", "three"], add_special_tokens=False)]


def test_known_parts_share_slots_and_survive_growth():
    t = packing.Tokens(queries.tokenizer_path())
    near = np.arange(300, dtype=np.uint64) << np.uint64(40)  # all at home in one slot, 0 among them
    far = np.unique(np.random.default_rng(3).integers(1, 1 << 63, 200_000, dtype=np.uint64))
    slots = len(t.size)
    for h in (near[:100], near[100:200], far):
        at = t.known
        t.keep(h, np.arange(at, at + len(h)) * 7, np.arange(at, at + len(h)) % 5 + 1)
        held = np.concatenate((near[: min(t.known, 200)], far if t.known > 200 else far[:0]))
        begin, size = t.find(held)
        assert (begin == np.arange(len(held)) * 7).all() and (size == np.arange(len(held)) % 5 + 1).all()
        assert not t.find(near[200:])[1].any()
    assert len(t.size) > slots and 2 * t.known <= len(t.size)


def test_parts_are_encoded_once(tokenizer):
    from itertools import product

    words = ["".join(w) for w in product("abcdefghijklmnopqrstuvwxyz", repeat=4)]
    texts = [" ".join(words[k : k + 2000]) for k in range(0, len(words), 2000)]
    t = packing.Tokens(queries.tokenizer_path())
    for k in range(0, len(texts), 50):  # 500,000 characters of parts: a multiple of BATCH
        t.encode(texts[k : k + 50])
    t.learn = None  # nothing is left to learn
    got = t.encode(texts[::40])
    assert [x.tolist() for x in got] == [e.ids for e in tokenizer.encode_batch(texts[::40], add_special_tokens=False)]


def test_parts_may_be_forgotten(tokenizer, monkeypatch):
    texts = ["one two three", "four five", "one 1 two 2", "six"]
    for name in ("WORDS", "IDS"):
        monkeypatch.setattr(packing, name, 2)
        t = packing.Tokens(queries.tokenizer_path())
        assert [t.encode([x])[0].tolist() for x in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert t.known == 1
        monkeypatch.undo()


def test_islands_of_one_task_breed_as_alone(spark, monkeypatch):
    items = spark.range(600).selectExpr("id as key", "pmod(xxhash64(id), 2000) + 1 as length")
    together = sorted(packing._islands(items, 2048, 64, 1).collect())
    monkeypatch.setattr(packing, "ISLES", 1)
    assert together == sorted(packing._islands(items, 2048, 64, 1).collect()) and len(together) == 600


def test_sequences_come_out_of_crossover(spark):
    got = queries.op8_packing(spark, "/root/testdata/sf0.01").toPandas()
    parts = got[got.generation.notna()]
    lengths = parts.length.to_numpy()
    assert (parts.generation > 0).mean() > 0.9 and parts.generation.max() > packing.GENERATIONS  # also after migration
    best_fit = packing.Packer(lengths, 2048, 0).fresh(0.0).max() + 1
    assert parts.sequence_id.nunique() <= best_fit


def test_packing_is_whole_and_tight(spark, tokenizer):
    extra = docs_of(spark, [(9001, None), (9002, ""), (9003, "a b"), (9003, "a b"), (None, "c"), (9004, "word " * 5000)])
    d = read(spark, "documents").select("doc_id", "text").unionByName(extra)
    got = packing.pack(d, queries.tokenizer_path(), group=64).collect()
    ids = {}
    for r in d.collect():
        data = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(data), 2048)):
            part = data[a : a + 2048]
            ids.setdefault((r.doc_id, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), []).append(r)
    assert sorted((str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)) == sorted(str(k) for k, v in ids.items() for _ in v)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= 1.01 * -(-sum(r.length for r in got) // 2048) + 1


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(2)
    p = packing.Packer(rng.integers(1, 2048, 500), 2048, 1)
    a, b = p.fresh(0.0), p.fresh(0.3)
    for _ in range(20):
        c = p.cross(a, b)
        assert c.min() == 0 and len(np.unique(c)) == c.max() + 1 and p.fills(c).max() <= 2048
        a, b = b, c
    many = packing.Packer(rng.integers(300, 900, 3000), 2048, 1)
    elite, born, begun = many.evolve([], 5, 12)
    assert born > 0 and elite.max() + 1 < begun
    assert p.worth(p.evolve([b], 4, 6, last=True)[0]) >= p.worth(p.fresh(0.0))


def test_chat_round_trip(spark):
    rng = random.Random(8)
    bits = ["\\", "<", ">", "</turn>\n", "<and>", "<turn:user>", "\\l", "\\b", "é🙂", "\n", "", "### x"]
    rows = [(c, t, rng.choice(["user", "assistant", "<turn:", None]), None if rng.random() < 0.1 else "".join(rng.choices(bits, k=5))) for c in [*range(40), None] for t in range(rng.randrange(1, 7))]
    rows.append(rows[0])
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "role as formatted", "text as runs")
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in got.items()} == want
    assert {c: r.loss for c, r in got.items()} == {c: [t for role, t in ts if role == "assistant"] for c, ts in want.items()}
    one = {r.conv_id: r for r in chat.digests(turns).collect()}
    for c, ts in want.items():
        loss = "".join(t for role, t in ts if role == "assistant")
        assert (one[c].n_turns, one[c].turns_sha256) == (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest())
        assert (one[c].loss_chars, one[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert one[c].formatted_chars == len(got[c].formatted)


def test_chat_plan_is_native(spark, capsys):
    chat.digests(read(spark, "conversations")).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_rule_counts_match_brute_force(spark):
    extra = [(9001, None), (9002, ""), (9003, "a b a b a b"), (9004, "x y\x1cz\x85w | #$%\n\n \n|\n |\n|"), (9005, "a a a"), (9006, "one two three one two three four")]
    d = read(spark, "documents").select("doc_id", "text").unionByName(docs_of(spark, extra))
    got = {r.doc_id: r for r in rules.apply_rules(d, read(spark, "labels")).collect()}
    for r in d.collect():
        text = r.text or ""
        w = WORDS.findall(text)
        seen, covered = {}, set()
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        for at in seen.values():
            if len(at) > 1:
                covered.update(x for k in at for x in range(k, k + 3))
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g.base_failed and g.kept)


def brute_lm(rows, target, vocabulary, folds, fold_of, least):
    """(doc_id, tokens, score) of each row, from counts in dictionaries."""
    texts = [(i, (t or "").lower().split()) for i, t in rows]
    words, pairs = Counter(), Counter()
    mine = [(Counter(), Counter()) for _ in range(folds)]
    for i, ws in texts:
        line = [*ws, None]
        for sums in [(words, pairs)] + ([mine[fold_of(i)]] if i in target else []):
            sums[0].update(line)
            sums[1].update(zip([None, *line], line, strict=False))
    of_bin = lambda n: int(np.floor(np.log2(n) * 8))
    size, bar = Counter(of_bin(n) for n in words.values() if n >= least), 512
    total = 0
    for b in sorted(size, reverse=True):
        total += size[b]
        if total > vocabulary:
            break
        bar = b
    known = {w for w, n in words.items() if n >= least and of_bin(n) >= bar}
    rare = {w for w, n in words.items() if n < least}

    def of_target(kind, key, m):
        return sum(x[kind][k] for f, x in enumerate(mine) if f != m for k in (rare if key == "rare" else [key]))

    def bits(kind, key, m, add):
        n = sum(words[k] for k in rare) if key == "rare" else (words, pairs)[kind][key]
        share = sum(sum(x[0].values()) for f, x in enumerate(mine) if f != m) / sum(words.values())
        return np.log2((n * share + add) / (of_target(kind, key, m) + add))

    out = []
    for i, ws in texts:
        line, m, total = [*ws, None], fold_of(i) if i in target else None, 0.0
        for h, w in zip([None, *line], line, strict=False):
            if h in known and w in known and pairs[h, w] >= least:
                total += bits(1, (h, w), m, lm_score.ADD) - bits(0, h, m, lm_score.ADD_FIRST)
            else:
                total += bits(0, "rare" if w in rare else w, m, lm_score.ADD)
        out.append((str(i), len(line), total / len(line)))
    return sorted(out)


@pytest.mark.parametrize(("vocabulary", "held"), [(1 << 19, 1 << 20), (1 << 19, 2), (1 << 19, 0), (5, 1 << 20), (5, 3), (0, 0)])
def test_lm_score_matches_brute_force(spark, vocabulary, held):
    rows = [(1, "the cat sat on a mat rat"), (2, "the dog sat on THE mat a rat"), (3, ""), (4, None), (5, "qq ww ee ww hat sat on the mat"), (2, "the dog sat on THE mat a rat"), (2, "another hat"), (None, "the cat hat bat sat on the rat"), (6, "on the mat the dog sat"), (7, "a rat on a mat")]
    target = {1, 5, 6, 7, 77}
    ids = spark.createDataFrame([(t,) for t in [*target, 5, None]], "doc_id long")
    of = {r.doc_id: r.f for r in ids.selectExpr("doc_id", "pmod(xxhash64(29, doc_id), 2) f").collect()}
    assert len({of[t] for t in target}) == 2
    want = brute_lm(rows, target, vocabulary, 2, of.get, 2)
    got = lm_score.cross_entropy_difference(docs_of(spark, rows), ids, vocabulary, held=held).collect()
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert sorted(g[2] for g in got) == pytest.approx(sorted(w[2] for w in want), abs=1e-5)
    assert {g[2] for g in map(tuple, lm_score.cross_entropy_difference(docs_of(spark, rows), ids.where("false"), vocabulary, held=held).select("doc_id", "n_tokens", "score").collect())} == {0.0}


def test_lm_scores_do_not_depend_on_how_statistics_travel(spark):
    rows = [(k, " ".join(f"w{j * j % 97}x" for j in range(k, k + 40 + k % 7))) for k in range(400)]
    docs = docs_of(spark, [*rows, *[(7, rows[7][1])] * 3000]).repartition(7)
    docs = docs.sortWithinPartitions("doc_id")
    target = docs.where("doc_id < 50")
    both = [sorted(map(tuple, lm_score.cross_entropy_difference(docs, target, 60, held=held, bucket_bytes=size).collect())) for held, size in ((lm_score.HELD, 1 << 20), (100, 1 << 20), (0, 40_000))]
    assert both[0] == both[1] == both[2] and len(both[0]) == 3400


def test_lm_table_counts_every_word_and_pair(spark):
    rows = [(k % 3, " ".join(f"w{j}x" for j in range(k, k + 40))) for k in range(300)]
    table, bits = lm_score.table_of(spark.createDataFrame(rows, "m int, text string"), 2, 2, 9000)
    got = {}
    for r in table.collect():
        keys, counts = lm_score.unpacked(bytes(r["keys"])), lm_score.widened(bytes(r["counts"]), 3)
        assert (np.diff(keys.astype(object)) > 0).all() and ((keys >> np.uint64(64 - bits)) == r["bucket"]).all()
        got |= dict(zip(keys.tolist(), counts.T.tolist(), strict=True))
    want = Counter()
    for m, t in rows:
        line = lm_score.Line([t])
        for k in [*line.word.tolist(), *line.pair.tolist()]:
            want[k, 0] += 1
            want[k, m] += m > 0
    assert got == {k: [n, want[k, 1], want[k, 2]] for (k, m), n in want.items() if m == 0 and n >= 2}
    words = [r.total[0] for r in table.collect()]
    assert sum(words) == sum(41 for _ in rows)


def test_packed_keys_come_back():
    rng = np.random.default_rng(0)
    for keys in (np.zeros(0, np.uint64), np.array([5], np.uint64), np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64)), np.sort(rng.integers(0, 1 << 40, 1000, dtype=np.uint64)), np.array([0, 0, (1 << 64) - 1], np.uint64)):
        assert (lm_score.unpacked(lm_score.packed(keys)) == keys).all()
    for counts in (np.zeros((3, 0), int), np.array([[1, 2], [300, 0], [1 << 40, 5]])):
        assert (lm_score.widened(lm_score.narrow(counts), 3) == counts).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    want = con.sql(queries.ORACLE_SQL[name])
    cols = want.columns
    got = queries.QUERIES[name](spark, SMALL).select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_first_lowest_is_argmin():
    rng = np.random.default_rng(5)
    for size, width in ((0, 26), (7, 26), (26, 26), (200, 1), (200, 2), (200, 5), (200, 26), (200, 27)):
        x = rng.integers(0, 9, size).astype(np.uint64)
        n = max(size - width + 1, 0)
        assert passage_dedup._first_lowest(x, width)[:n].tolist() == [k + int(x[k : k + width].argmin()) for k in range(n)]


def test_texts_without_mixed_spans_are_not_read_again(spark):
    """The last pass over the texts hashes the windows of those in its map alone."""
    texts = [" ".join(f"w{k * j}" for k in range(90)) for j in (1, 7)]
    docs = docs_of(spark, list(enumerate(texts))).selectExpr("doc_id AS __ld_id", "false AS __ld_null", "xxhash64(text) AS __ld_th", "text")
    full = spark.sparkContext.broadcast(b"\xff" * (1 << (decontaminate.MAP_BITS - 3)))
    one = decontaminate._map_of(docs.where("__ld_id = 1").selectExpr("__ld_th AS wh"))
    kind = "__ld_id long, __ld_null boolean, __ld_th long, h1 long, h2 long, pos int, salt long"
    got = docs.mapInArrow(passage_dedup._windows(50, full, one), kind).collect()
    assert [(r[0], r.pos) for r in got] == [(1, k) for k in range(41)]


def test_spans_are_merged_row_by_row():
    rng = np.random.default_rng(2)
    for size in (0, 1, 300):
        row, a = rng.integers(0, 20, size), rng.integers(0, 60, size)
        b = a + rng.integers(1, 9, size)
        inside = {(r, k) for r, x, y in zip(row.tolist(), a.tolist(), b.tolist(), strict=True) for k in range(x, y)}
        got = list(zip(*(x.tolist() for x in passage_dedup.merge_spans(row, a, b)), strict=True))
        assert got == sorted(got) and {(r, k) for r, x, y in got for k in range(x, y)} == inside
        assert all(p[0] < q[0] or p[2] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_later_windows_of_a_batch():
    rng = np.random.default_rng(4)
    for size in (0, 1, 2, 400):
        h1, h2, ids, pos = rng.integers(0, 40, size), rng.integers(0, 3, size), rng.integers(0, 9, size), rng.integers(0, 5, size)
        rows = list(zip(h1.tolist(), h2.tolist(), ids.tolist(), pos.tolist(), strict=True))
        first = {}
        for a, b, *at in sorted(rows):
            first.setdefault((a, b), (a, b, *at))
        assert passage_dedup.later_ones(h1, h2, [ids, pos]).tolist() == [first[r[:2]] != r for r in rows]


def test_repeated_rows_keep_a_passage_that_others_have_too(spark):
    """Rows of one id and text are one document: the passage stays in both, and goes from what follows."""
    rng = np.random.default_rng(6)
    shared = [f"s{k}" for k in rng.integers(0, 999, 70)]
    text = {i: " ".join([f"a{i}x{k}" for k in range(5)] + shared[i % 3 : 70 - i % 2] + [f"b{i}"]) for i in (1, 2, 3, 4)}
    rows = [(1, text[1]), (1, text[1]), (2, text[2]), (3, text[3]), (3, text[3]), (4, text[4])]
    got = sorted((r.doc_id, r.text) for r in passage_dedup.passage_dedup(docs_of(spark, rows).coalesce(1)).collect())
    assert got[0] == got[1] == (1, text[1]) and got[3] == got[4]
    want = brute_passages([(i, text[i]) for i in text], 50)
    assert [WORDS.findall(t) for _, t in got] == [want[i] for i, _ in rows]


def test_near_dedup_leaves_texts_in_place(spark, capsys):
    """Texts are not shuffled where few go, and where none of them repeat row by row."""
    docs = read(spark, "documents").dropDuplicates(["doc_id"])
    docs = docs.sparkSession.createDataFrame(docs.limit(300).toPandas(), docs.schema)
    simhash.drop_near_duplicates(docs).explain()
    assert not re.search("Exchange (hash|range)partitioning", capsys.readouterr().out)
