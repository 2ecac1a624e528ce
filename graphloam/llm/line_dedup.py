"""Line dedup (operator 3): repeated windows of three lines, built with DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, release

LINES = 3
KEYS = ["__ld_id", "__ld_null", "__ld_th"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__ld_id": F.coalesce("doc_id", F.lit(-(1 << 63))), "__ld_null": F.col("doc_id").isNull(), "__ld_th": F.xxhash64("text")})


def _marked(docs: DataFrame, lines: int) -> DataFrame:
    """``docs`` with __ld_lines (the lines) and __ld_cut (positions to remove, null if none)."""
    keyed = _keyed(docs)
    split = F.split("text", "\n", -1)
    texts = keyed.select(*KEYS, split.alias("ls")).where("ls is not null")
    of_line = {"a": lambda x: F.xxhash64(x), "b": lambda x: F.xxhash64(F.lit(lines), x), "ok": lambda x: F.btrim(x, F.lit(" \t\n\v\f\r")) != ""}
    texts = texts.select(*KEYS, *(F.transform("ls", f).alias(k) for k, f in of_line.items()))
    window = lambda k, i: [F.get(F.col(k), i + n) for n in range(lines)]  # noqa: E731  null beyond the last line, which hashes leave out
    starts = F.sequence(F.lit(0), F.greatest(F.size("a") - lines, F.lit(0)))
    each = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(*window("a", i)).alias("h1"), F.xxhash64(*window("b", i)).alias("h2"), F.coalesce(*(F.when(x, x) for x in window("ok", i)), F.lit(False)).alias("words")))
    seen = cut(texts.select(*KEYS, F.explode(F.filter(each, lambda w: w.words)).alias("w")).select(*KEYS, "w.h1", "w.h2", "w.pos"))

    at = F.struct(F.col("__ld_null"), F.col("__ld_id"), F.col("__ld_th"), F.col("pos"))  # rows without an id come last
    again = cut(seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1").select("h1", "h2", "first"))
    later = seen.join(again, ["h1", "h2"]).where(at != F.col("first")).select(*KEYS, "pos")
    covered = later.groupBy(*KEYS).agg(F.collect_set("pos").alias("p"))
    covered = covered.select(*KEYS, F.array_distinct(F.flatten(F.transform("p", lambda i: F.sequence(i, i + (lines - 1))))).alias("__ld_cut"))
    covered = cut(covered)
    del seen, again, later
    release(docs.sparkSession)
    if (covered.agg(F.sum(F.size("__ld_cut"))).first()[0] or 0) <= BROADCAST_ROWS:  # so many positions: texts stay in place
        covered = F.broadcast(covered)
    return keyed.join(covered, KEYS, "left").withColumn("__ld_lines", split)


def _kept():
    keep = F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), F.col("__ld_cut"))
    return F.when(F.col("__ld_cut").isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.element_at("__ld_lines", i + 1)), "\n"))


def line_dedup(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``docs`` with every later occurrence of a repeated run of ``lines`` consecutive lines cut out of ``text``.

    Windows overlap: each line starts one, the last lines - 1 don't; a text of fewer lines is one window of all it has.
    Windows are compared by 128 bits of hash over all texts.  The first occurrence is the one with the smallest doc_id
    (null last), then text hash, then position; what later ones cover is merged and removed.  Windows without a word
    are no evidence.  Null texts stay null, a text of which nothing is left becomes empty, rows are never dropped.
    Identical rows (same id and text) are one document and get the same result each.  All columns come back, ``text``
    changed.  An empty table stays empty.
    """
    marked = _marked(docs, lines)
    return marked.withColumn("text", _kept()).select(*docs.columns)


def line_dedup_report(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every row of ``docs``; see ``line_dedup``."""
    marked = _marked(docs.select("doc_id", "text"), lines)
    n = F.coalesce(F.size("__ld_lines"), F.lit(0))
    kept = F.size(F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), F.col("__ld_cut")))
    removed = F.when(F.col("__ld_cut").isNull(), 0).otherwise(n - kept)
    return marked.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), _kept().alias("text"))
