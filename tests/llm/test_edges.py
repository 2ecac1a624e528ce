"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import corpus_pipeline
import pytest
from graphloam.llm import chat, decontaminate, language, line_dedup, lm_score, packing, passage_dedup, quality, queries, rules, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos long, fp string, score double, y int, key string, word string, __v string"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 40_000
ROWS = [
    (None, None, None, None, None, None, None, None, None, None, None, None),
    (1, "", "en", "a", 0, 1, "x", 0.5, 1, "k", "w", "v"),
    (2, LONG, "en", "a", len(LONG), 1, "x", 0.5, 1, "k", "w", "v"),
    (3, "eins zwei drei vier fünf sechs\nzwei\ndrei", "de", "a", 1, 1, "x", 0.5, 1, "k", "w", "v"),
    (3, "eins zwei drei vier fünf sechs\nzwei\ndrei", "de", "a", 1, 1, "x", 0.5, 1, "k", "w", "v"),
    (3, "un deux trois", "fr", "a", 1, 1, "x", 0.5, 1, "k", "w", "v"),
    (None, "you are an idiot !!! \\ </turn>", None, "a", 1, 1, "x", 0.5, 1, "k", "w", "v"),
    (4, "\n\n \n", "en", "a", 1, 1, "x", 0.5, 1, "k", "w", "v"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None), (99, 1, 1)]
OPERATORS = {
    "decontaminate": lambda d, lb, b: decontaminate.decontaminate(d, b),
    "contaminated": lambda d, lb, b: decontaminate.contaminated(d, b),
    "quality": lambda d, lb, b: quality.score_quality(d, lb),
    "line_dedup": lambda d, lb, b: line_dedup.line_dedup(d),
    "passage_dedup": lambda d, lb, b: passage_dedup.passage_dedup(d),
    "lm_score": lambda d, lb, b: lm_score.score_against_good(d, lb, 8),
    "simhash": lambda d, lb, b: simhash.simhash_groups(d),
    "near_dedup": lambda d, lb, b: simhash.drop_near_duplicates(d),
    "toxicity": lambda d, lb, b: toxicity.score_toxicity(d, lb),
    "drop_toxic": lambda d, lb, b: toxicity.drop_toxic(d, lb),
    "rules": lambda d, lb, b: rules.apply_rules(d, lb),
    "packing": lambda d, lb, b: packing.pack(d, queries.tokenizer_path()),
    "language": lambda d, lb, b: language.identify(d),
}
SAME_ROWS = {"quality", "line_dedup", "passage_dedup", "lm_score", "simhash", "toxicity", "rules", "language"}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (None, None), (2, "x"), (2, "x")], "item_id long, text string")
    return docs, labels, bench


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(tables, name):
    got = OPERATORS[name](*tables).collect()
    if name in SAME_ROWS:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    if name in ("line_dedup", "near_dedup", "drop_toxic", "decontaminate"):
        assert not got or got[0].__fields__ == tables[0].columns
    if name == "decontaminate":
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS if r[0] != 2)
    if name == "contaminated":  # the long text holds item 1; items of one word match nothing here
        assert [(r.doc_id, r.item_id, r.coverage, r.first_word) for r in got] == [(2, 1, 1.0, 0)]
    if name == "packing":  # a piece of every row, the long text cut every 2048 ids
        assert sorted(str(r.doc_id) for r in got if r.piece == 0) == sorted(str(r[0]) for r in ROWS)
        long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 2)
        assert [p for p, _, _ in long] == list(range(len(long))) and all(n == 2048 for _, _, n in long[:-1]) and long[-1][1] == 2048 * (len(long) - 1)
    if name == "drop_toxic":
        scores = sorted((str(r.doc_id), r.score) for r in toxicity.score_toxicity(*tables[:2]).collect())
        assert sorted(str(r.doc_id) for r in got) == [k for k, s in scores if s < toxicity.THRESHOLD]
    if name == "near_dedup":  # empty and null texts are one group, the repeated row stays once
        assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "3", "None"]
    if name == "language":
        assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1, 4)} == {("und", 0.0)}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(tables, name):
    docs, labels, bench = tables
    assert OPERATORS[name](docs.where("false"), labels.where("false"), bench.where("false")).collect() == []
    OPERATORS[name](docs, labels.where("false"), bench.where("false")).collect()


def test_no_conversations(spark):
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_null_and_tied_turns_and_a_long_conversation(spark):
    rows = [(1, None, "user", "b"), (1, None, "user", "a"), (1, 2, "assistant", "z"), (1, 2, "assistant", "y"), (1, 2, "user", None), (1, 2, "user", None), (None, 1, None, "q")]
    rows += [(2, k, ("user", "assistant")[k % 2], f"<turn {k}>\\") for k in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "a"), ("user", "b"), ("assistant", "y"), ("assistant", "z"), ("user", ""), ("user", "")]
    assert [(t.role, t.text) for t in got[2].turns] == [r[2:] for r in rows if r[0] == 2] and [(t.role, t.text) for t in got[None].turns] == [("", "q")]
    assert got[2].loss == [r[3] for r in rows if r[0] == 2 and r[2] == "assistant"]


def test_survivors_do_not_depend_on_row_order(spark):
    rows = [(1, "same text here", k) for k in range(5)] + [(2, "same text here", 9)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, n long")
        kept = [tuple(r) for r in simhash.drop_near_duplicates(docs).collect()]
        assert len(kept) == 1 and kept[0][:2] == (1, "same text here")
        first = kept if order is rows else first
    assert first == kept


def test_pipeline_stages_keep_their_promises(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = ({r.doc_id for r in x.select("doc_id").collect()} for x in (docs, out))
        if name == "packing":
            assert after == before
            break
        assert out.columns == docs.columns
        labels = spark.read.parquet(f"{sf}/labels.parquet")
        gone = {
            "toxicity": lambda: {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()},
            "line_dedup": set,
            "near_dedup": lambda: {r.doc_id for r in simhash.simhash_groups(docs).where("doc_id <> component_id").collect()},
            "decontamination": lambda: {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()},
        }[name]()
        assert after == before - gone
        docs = out
    whole = {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {(r.doc_id, r.piece, r.ids_crc32) for r in out.collect()}


def test_pipeline_takes_empty_and_odd_tables(spark, tables, tmp_path):
    docs, labels, bench = tables
    for n, t in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        for kind, rows in (("odd", t), ("empty", t.where("false"))):
            if (kind, n) == ("odd", "labels"):
                rows = rows.where("toxic = 0")  # nothing to learn toxicity from, so no document is rejected
            rows.write.parquet(f"{tmp_path}/{kind}/{n}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/odd").count() > 0
