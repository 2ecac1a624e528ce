"""Scans and sinks of graphs and covers.  Parsers take a DataFrame with a column ``value``, as ``spark.read.text`` gives."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import number


def _long(c: Column) -> Column:
    return c.try_cast("bigint")


def weighted_edges(lines: DataFrame) -> DataFrame:
    """(src, dst, w) of lines ``src dst [w]``; a missing weight is 1; comments, blank and malformed lines are dropped."""
    part = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.where(~F.col("value").rlike(r"^\s*#")).select(_long(F.get(part, F.lit(0))).alias("src"), _long(F.get(part, F.lit(1))).alias("dst"), F.get(part, F.lit(2)).alias("s"))
    w = F.when(F.col("s").isNull(), F.lit(1.0)).otherwise(F.col("s").try_cast("double"))
    return rows.select("src", "dst", w.alias("w")).where("src is not null and dst is not null and w is not null")


def plain_edges(lines: DataFrame) -> DataFrame:
    """(src, dst, w = 1) of lines that begin with two integers; comments are dropped."""
    part = F.split(F.trim(F.regexp_replace("value", r"[\s,]+", " ")), " ")
    rows = lines.where(~F.col("value").rlike(r"^\s*#")).select(_long(F.get(part, F.lit(0))).alias("src"), _long(F.get(part, F.lit(1))).alias("dst"), F.lit(1.0).alias("w"))
    return rows.where("src is not null and dst is not null")


def delimited_network(lines: DataFrame, sep: str = "|") -> tuple[DataFrame, DataFrame]:
    """(edges (src, dst, w), vertices (name)) of lines of three fields; fields are trimmed and empty ones dropped.

    Rows with another number of fields are skipped.  A row with a bad weight gives its vertices but no edge."""
    fields = F.filter(F.transform(F.split("value", f"[{sep}]"), lambda x: F.trim(x)), lambda x: x != "")
    rows = lines.select(fields.alias("f")).where("size(f) = 3")
    named = rows.select(F.col("f")[0].alias("src"), F.col("f")[1].alias("dst"), F.col("f")[2].try_cast("double").alias("w"))
    return named.where("w is not null"), named.select(F.explode(F.array("src", "dst")).alias("name")).distinct()


def communities(lines: DataFrame, key: Column, sep: str = "|") -> DataFrame:
    """(comm_id, member): one community a line, numbered by ``key``."""
    fields = F.filter(F.transform(F.split("value", f"[{sep}]"), lambda x: F.trim(x)), lambda x: x != "")
    return lines.select(key.cast("bigint").alias("comm_id"), F.explode(fields).alias("member"))


def result_log(lines: DataFrame) -> DataFrame:
    """(comm_id, member) of lines ``name result:[[..], ..]``; communities are numbered by size descending, then members."""
    body = F.regexp_extract("value", r"^name result\s*:\s*(\[\[.*\]\])", 1)
    rows = lines.where(body != "").select(F.monotonically_increasing_id().alias("line"), F.posexplode(F.from_json(body, "array<array<bigint>>")).alias("at", "m"))
    keyed = rows.select(F.array_sort("m").alias("m"), F.struct((-F.size("m")).alias("n"), F.array_sort("m").alias("m"), "line", "at").alias("key"))
    return number(keyed, "key").select(F.col("idx").alias("comm_id"), F.explode("m").alias("member"))


def log_fields(lines: DataFrame) -> DataFrame:
    """(comm_size, time_ms) of the lines ``comm size:N`` and ``whole execution time:T ms`` of a result log; null if absent."""
    part = lambda p, kind: F.max(F.nullif(F.regexp_extract("value", p, 1), F.lit("")).try_cast(kind))
    return lines.agg(part(r"^comm[ _]size\s*:\s*(\d+)", "bigint").alias("comm_size"), part(r"^whole execution time\s*:\s*([\d.]+)", "double").alias("time_ms"))


def member_lists(lines: DataFrame, names: DataFrame, pos: str) -> DataFrame:
    """(comm_id, member): after a line ``comm_size..`` each line that begins with a digit is a community, numbered by ``pos``.

    Its members, apart by commas or blanks, are names of ``names`` (idx, name); of ``name(idx)`` the name counts."""
    begin = lines.where(F.col("value").rlike("^comm_size")).agg(F.min(pos).alias("__begin"))
    after = lines.join(F.broadcast(begin), F.col(pos) > F.col("__begin")).where(F.col("value").rlike("^[0-9]"))  # one row
    each = after.select(F.col(pos).alias("comm_id"), F.explode(F.regexp_extract_all(F.regexp_replace("value", r"\(\d+\)", ""), F.lit(r"(\d+)"), F.lit(1))).alias("s"))
    named = each.select("comm_id", _long(F.col("s")).alias("name")).join(names, "name")
    return named.select("comm_id", F.col("idx").alias("member"))


def read_smat(spark: SparkSession, path: str, pattern: bool = True) -> tuple[DataFrame, tuple[int, int]]:
    """(edges, (m, n)) of a file in the sparse-matrix format: its size is the first line, or the file ``path``.info.

    Files with an .info beside them have no header; ``.gz`` is read as it is."""
    try:
        size = spark.read.text(f"{path}.info").where("trim(value) <> ''").first()
    except AnalysisException:
        size = None
    lines = spark.read.text(path)
    m, n = (int(x) for x in (size or lines.first()).value.split()[:2])
    if size is None:  # the header is the first line of the file
        lines = lines.withColumn("at", F.col("_metadata.file_block_start")).withColumn("k", F.monotonically_increasing_id()).where("not (at = 0 and k = 0)")
    return smat(lines.select("value"), pattern), (m, n)


def smat(lines: DataFrame, pattern: bool = True) -> DataFrame:
    """(src, dst, w) of ``i j v`` lines (0-based), duplicates summed; pass the lines without the header ``m n nnz``.

    ``pattern``: weights become 1 and the diagonal is dropped."""
    summed = weighted_edges(lines).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return summed.where("src <> dst").withColumn("w", F.lit(1.0)) if pattern else summed


def adjacency(lines: DataFrame) -> DataFrame:
    """(src, dst, w = 1) of a literal ``{v: {a, b}, ..}`` that may run over lines; v may stand once a line."""
    pairs = lines.select(F.explode(F.regexp_extract_all("value", F.lit(r"(\d+)\s*:\s*[\{\[]([^}\]]*)[\}\]]"), F.lit(0))).alias("p"))
    key = F.regexp_extract("p", r"^(\d+)", 1).cast("bigint")
    return pairs.select(key.alias("src"), F.explode(F.regexp_extract_all(F.regexp_extract("p", r"[\{\[](.*)[\}\]]", 1), F.lit(r"(\d+)"), F.lit(1))).alias("d")).select("src", F.col("d").cast("bigint").alias("dst"), F.lit(1.0).alias("w"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files; ``.gz`` is read as it is."""
    return spark.read.text(path)


def network_lines(edges: DataFrame, sep: str = "|") -> DataFrame:
    """value: ``src|dst|w``; write with ``.write.text``."""
    return edges.select(F.concat_ws(sep, "src", "dst", "w").alias("value"))


def community_lines(cover: DataFrame, sep: str = "|") -> DataFrame:
    """value: the members of each community in order."""
    return cover.groupBy("comm_id").agg(F.array_join(F.array_sort(F.collect_set("member")).cast("array<string>"), sep).alias("value")).select("value")


def change_delimiter(lines: DataFrame, old: str, new: str) -> DataFrame:
    return lines.select(F.replace("value", F.lit(old), F.lit(new)).alias("value"))


def result_lines(cover: DataFrame, names: DataFrame | None = None, elapsed_ms: float | None = None) -> DataFrame:
    """value: the lines of a result log: ``comm size``, then communities by index and by name, then the time.

    Communities stand in the order of comm_id on lines of their own (``idx result`` and ``name result`` each hold one, so
    no line grows with the cover); members are in order.  names (idx, name): without it members are names already."""
    text = lambda c, kind: F.concat(F.lit(f"{kind} result:[["), F.array_join(F.array_sort(F.collect_set(c)).cast("array<string>"), ", "), F.lit("]]"))
    rows = cover if names is None else cover.join(names, cover.member == names.idx)
    one = rows.groupBy("comm_id").agg(text(F.col("member"), "idx").alias("a"), text(F.col("member" if names is None else "name"), "name").alias("b"))
    body = one.select(F.explode(F.array(F.struct(F.lit(1).alias("k"), F.col("comm_id").alias("c"), F.col("a").alias("value")), F.struct(F.lit(2).alias("k"), F.col("comm_id").alias("c"), F.col("b").alias("value")))).alias("r")).select("r.*")
    head = cover.agg(F.concat(F.lit("comm size:"), F.countDistinct("comm_id").cast("string")).alias("value")).select(F.lit(0).alias("k"), F.lit(0).cast("long").alias("c"), "value")
    out = head.unionByName(body)
    if elapsed_ms is not None:
        out = out.unionByName(cover.sparkSession.createDataFrame([(3, 0, f"whole execution time:{elapsed_ms:g} ms")], "k int, c long, value string"))
    return out.orderBy("k", "c").select("value")


def named_lines(cover: DataFrame, names: DataFrame) -> DataFrame:
    """value: ``name(idx),name(idx),`` of each community, members in the order of their indices."""
    rows = cover.join(names, cover.member == names.idx)
    return rows.groupBy("comm_id").agg(F.array_sort(F.collect_set(F.struct("idx", "name"))).alias("m")).select(F.array_join(F.transform("m", lambda x: F.concat(x["name"].cast("string"), F.lit("("), x["idx"].cast("string"), F.lit("),"))), "").alias("value"))


def numbered_lines(cover: DataFrame) -> DataFrame:
    """(value[, level]): ``id <tab> [members]`` of each community, members in order; write with ``partitionBy("level")``."""
    by = ["level", "comm_id"] if "level" in cover.columns else ["comm_id"]
    text = F.concat(F.col("comm_id").cast("string"), F.lit("\t["), F.array_join(F.col("m").cast("array<string>"), ", "), F.lit("]"))
    return cover.groupBy(*by).agg(F.array_sort(F.collect_set("member")).alias("m")).select(text.alias("value"), *by[:-1])


def pretty(column: Column, kind: str = "list") -> Column:
    """An array as text: ``[a, b]``, a set as ``{a, b}``, a tuple as ``(a, b)``; nested arrays of texts may be given."""
    left, right = {"list": "[]", "set": "{}", "tuple": "()"}[kind]
    return F.concat(F.lit(left), F.array_join(column.cast("array<string>"), ", "), F.lit(right))


def parameters(argv: list[str], defaults: dict | None = None) -> dict:
    """``-flag value`` pairs over ``defaults``, values in the type of the default; ``+several words+`` are one value.

    A flag without a value is true; of a boolean 1, true, t and yes are true."""
    out, k = dict(defaults or {}), 0
    while k < len(argv):
        flag = argv[k].lstrip("-")
        k += 1
        if k == len(argv) or (argv[k][:1] == "-" and not argv[k][1:2].isdigit()):
            out[flag] = True
            continue
        value = argv[k]
        k += 1
        if value.startswith("+"):
            while not (value.endswith("+") and len(value) > 1):
                if k == len(argv):
                    raise ValueError(f"no closing + for {flag}")
                value += " " + argv[k]
                k += 1
            value = value[1:-1]
        usual = (defaults or {}).get(flag)
        out[flag] = value.lower() in ("1", "true", "t", "yes") if isinstance(usual, bool) else type(usual)(value) if usual is not None else value
    return out


def drawn(salt: int) -> Column:
    """A number from 0 to 1 by ``id``: two steps of a multiplicative generator modulo 2 ** 31 - 1, the same on every cluster."""
    m = F.lit((1 << 31) - 1)
    x = ((F.col("id") + salt) % m * 48271 + 1) % m
    return ((x * x % m) * 69621 % m) / m


def chirikov(spark: SparkSession, nx: int, np_: int, steps: int, k: float, eta: float, samples: int, seed: int = 0) -> DataFrame:
    """(src, dst, w): cells of the torus joined by samples of the standard map after ``steps`` steps; w counts hits.

    Samples are drawn by their number, so the edges do not depend on the partitions."""
    cell = F.col("id") % (nx * np_)
    two_pi = 2 * math.pi
    at = spark.range(nx * np_ * samples).select(cell.alias("src"), ((cell % nx + drawn(seed * 2 + 1)) / nx).alias("x"), ((F.floor(cell / nx) + drawn(seed * 2 + 7_919)) / np_).alias("p"))
    for _ in range(steps):
        at = at.withColumn("p", F.pmod(F.lit(eta) * F.col("p") + F.lit(k / two_pi) * F.sin(two_pi * F.col("x")), F.lit(1.0)))
        at = at.withColumn("x", F.pmod(F.col("x") + F.col("p"), F.lit(1.0)))
    dst = F.least(F.floor(F.col("x") * nx), F.lit(nx - 1)) + nx * F.least(F.floor(F.col("p") * np_), F.lit(np_ - 1))
    return at.groupBy("src", dst.cast("bigint").alias("dst")).agg(F.count("*").cast("double").alias("w"))
