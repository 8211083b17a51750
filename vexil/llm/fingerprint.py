"""Document fingerprints by invertible Bloom lookup, with DataFrame functions only.

A text's paragraphs, its lines cut after their sentences, become 64-bit digests. Each digest goes into one cell of each of three tables; a cell holds a count, the exclusive or of its digests, and the
exclusive or of a second hash of them. Two versions' cells subtract, and what both share cancels. A cell left with one digest (count 1 or -1 and a matching second
hash) gives that digest away; taking it out of its other cells makes more such cells. If cells remain, the pair is tried again with three times as many.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexil.llm.common import stash

TABLES, SWEEPS, GROWTH = 3, 5, 3
#: Cells of the fingerprint that is shown; least cells of a comparison, and more for each digest of the two.
SHOWN, LEAST, FIRST = 12, 24, 0.75
#: Where a paragraph ends: at a line's end, and after a sentence's within a line, in lines of any length.
PARAGRAPH_END = r"\n|(?<=[.!?]) "
#: Rows a bucket of neighbours, and the most bounds that a plan carries; a table of more rows has fuller buckets, whose sort spills.
ROWS_A_BUCKET, MOST_BUCKETS = 1024, 1 << 16


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs (lines, cut after their sentences) of a text; null counts as empty, and empty paragraphs don't count."""
    parts = F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END)
    return F.array_distinct(F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.xxhash64(x)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(101))


def _cell(key: Column, table: int, cells: Column) -> Column:
    size = F.floor(cells / TABLES).cast("int")
    return F.lit(table) * size + F.pmod(F.xxhash64(key, F.lit(table)), size).cast("int")


def _insert(rows: DataFrame, by: list[str], signed: Column, cells: Column) -> DataFrame:
    """(by..., m, cell, key, n, k, h): summed cells of an array of (digest, sign) in each row. A row with cell -3 stands for each input row."""
    one = rows.select(*by, cells.alias("m"), F.explode_outer(signed).alias("e")).select(*by, "m", F.col("e.x").alias("x"), F.col("e.s").alias("s"))
    entry = lambda cell, n: F.struct(cell.cast("int").alias("cell"), n.alias("n"))
    every = F.array(*(entry(_cell(F.col("x"), t, F.col("m")), F.col("s")) for t in range(TABLES)))
    dealt = one.select(*by, "m", "x", F.explode(F.when(F.col("x").isNull(), F.array(entry(F.lit(-3), F.lit(0)))).otherwise(every)).alias("c"))
    return _summed(dealt.select(*by, "m", "c.cell", F.lit(0).cast("long").alias("key"), "c.n", F.coalesce("x", F.lit(0)).alias("k"), F.coalesce(_check(F.col("x")), F.lit(0)).alias("h")), by)


def _summed(cells: DataFrame, by: list[str]) -> DataFrame:
    out = cells.groupBy(*by, "m", "cell", "key").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    return out.filter("cell < 0 or n <> 0 or k <> 0 or h <> 0")


def _peeled(cells: DataFrame, by: list[str], keep: bool) -> DataFrame:
    """cells with as many digests taken out as SWEEPS over the tables find: n of them in rows with cell -1 for the first version and -2 for the second, with keep a row
    for each digest.

    A round looks at one table only, in which a digest has one cell, so none is taken out twice. Nothing is shuffled: `by` holds what rows are dealt by.
    """
    for r in range(SWEEPS * TABLES):
        t = r % TABLES
        size = F.floor(F.col("m") / TABLES).cast("int")
        pure = (F.col("cell") >= t * size) & (F.col("cell") < (t + 1) * size) & (F.abs("n") == 1) & (F.col("h") == _check(F.col("k")))
        row = lambda cell, key, n, k, h: F.struct(cell.cast("int").alias("cell"), key.cast("long").alias("key"), n.alias("n"), k.alias("k"), h.alias("h"))
        zero = F.lit(0).cast("long")
        taken = [row(F.when(F.col("n") > 0, -1).otherwise(-2), F.col("k") if keep else zero, F.lit(1), zero, zero)]
        taken += [row(_cell(F.col("k"), o, F.col("m")), zero, -F.col("n"), F.col("k"), F.col("h")) for o in range(TABLES) if o != t]
        same = F.array(row(F.col("cell"), F.col("key"), F.col("n"), F.col("k"), F.col("h")))
        cells = _summed(cells.select(*by, "m", F.explode(F.when(pure, F.array(*taken)).otherwise(same)).alias("c")).select(*by, "m", "c.*"), by)
    return cells


def differences(pairs: DataFrame, parts: int, most_tries: int = 16) -> DataFrame:
    """(row, kind, only_a, only_b) for pairs(row, kind, a, b) of digest arrays: how many digests only one version has, as peeling recovers them.

    The first try has cells for half of all digests of both; pairs that aren't recovered whole are tried again with GROWTH times as many.
    """
    by = ["row", "kind"]
    todo = pairs.withColumn("m", (F.ceil((LEAST + FIRST * (F.size("a") + F.size("b"))) / TABLES) * TABLES).cast("int"))
    done: DataFrame | None = None
    for _ in range(most_tries):
        side = lambda c, s: F.transform(c, lambda x: F.struct(x.alias("x"), F.lit(s).alias("s")))
        first = F.array(F.struct(F.lit(None).cast("long").alias("x"), F.lit(0).alias("s")))
        # repartition() deals arrays by row; all aggregates that follow have row among their keys
        cells = _insert(todo.repartition(parts, "row"), by, F.concat(first, side("a", 1), side("b", -1)), F.col("m"))
        many = lambda cell: F.sum(F.when(F.col("cell") == cell, F.col("n")).otherwise(0))
        out = _peeled(cells, by, False).groupBy(*by, "m").agg(F.count_if(F.col("cell") >= 0).alias("left"), many(-1).alias("only_a"), many(-2).alias("only_b"))
        out = stash(out, "peeled")
        good = out.filter("left = 0").select("row", "kind", "only_a", "only_b")
        done = done.union(good) if done else good
        failed = out.filter("left > 0").select("row", "kind", (F.col("m") * GROWTH).alias("m"))
        if failed.isEmpty():
            return done
        todo = pairs.join(failed, by)
    raise RuntimeError("paragraph digests weren't recovered")


def recovered(pairs: DataFrame, cells: int, parts: int) -> DataFrame:
    """(row, kind, left, only_a, only_b) with the recovered digests themselves, sorted, after one try with so many cells; left > 0 means that it takes more."""
    by = ["row", "kind"]
    side = lambda c, s: F.transform(c, lambda x: F.struct(x.alias("x"), F.lit(s).alias("s")))
    first = F.array(F.struct(F.lit(None).cast("long").alias("x"), F.lit(0).alias("s")))
    done = _peeled(_insert(pairs.repartition(parts, "row"), by, F.concat(first, side("a", 1), side("b", -1)), F.lit(cells)), by, True)
    keys = lambda cell: F.sort_array(F.collect_list(F.when(F.col("cell") == cell, F.col("key"))))
    return done.groupBy(*by).agg(F.count_if(F.col("cell") >= 0).alias("left"), keys(-1).alias("only_a"), keys(-2).alias("only_b"))


def shown(rows: DataFrame, parts: int) -> DataFrame:
    """(row, kind, fingerprint) for rows(row, kind, a): SHOWN cells in order, each as count, digests and checks in hexadecimal digits; no digests, no digits."""
    by = ["row", "kind"]
    signed = F.transform("a", lambda x: F.struct(x.alias("x"), F.lit(1).alias("s")))
    cells = _insert(rows.repartition(parts, "row"), by, signed, F.lit(SHOWN))
    text = F.format_string("%d.%x.%016x%08x", "cell", "n", "k", F.col("h").bitwiseAND(F.lit(2**32 - 1)))
    whole = F.sort_array(F.collect_list(F.when(F.col("cell") >= 0, F.struct("cell", text.alias("text")))))
    return cells.groupBy(*by).agg(F.array_join(F.transform(whole, lambda x: x["text"]), ";").alias("fingerprint"))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """The place of the first bound that isn't below the id, found in two steps; null goes to the first."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.from_json(F.lit(json.dumps([g[-1] for g in groups])), "array<bigint>")
    inner = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    below = lambda xs: F.size(F.filter(xs, lambda x: x < doc_id))
    i = F.least(below(tops), F.lit(len(groups) - 1))
    return F.when(doc_id.isNull(), 0).otherwise(i * step + below(F.element_at(inner, i + 1))).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, items) with next_text and next_items, those of the next row by descending doc_id; after the last comes the first.

    Ids are cut into buckets of about a thousand rows at bounds that are ids of the table; a bucket's rows and a copy of the row that follows its last are sorted as one
    window. So no task holds more than its buckets (beyond 67 million rows there are 65,536 fuller ones), and each text is shuffled once (and once more for one row a bucket). Rows of equal id follow by text; null ids
    come last, and if all ids are null nothing follows the last row.
    """
    n, top = docs.agg(F.count("doc_id"), F.max("doc_id")).first()
    parts = max(1, min(MOST_BUCKETS, -(-n // ROWS_A_BUCKET)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 16 * parts)).first()[0] or []
    bounds = sorted({*(cuts if parts > 1 else []), *([top] if top is not None else [])}) or [0]
    bucket = _bucket(F.col("doc_id"), bounds)
    known = docs.withColumn("bucket", bucket)
    here = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest"))
    bound = F.element_at(F.from_json(F.lit(json.dumps(bounds)), "array<bigint>"), F.col("bucket") + 1)
    there = F.struct(F.pmod(F.col("bucket") + 1, F.lit(len(bounds))).cast("int").alias("b"), F.when(F.col("bucket") == len(bounds) - 1, 2).otherwise(1).alias("guest"))
    dealt = known.withColumn("at", F.explode(F.when(F.col("doc_id") == bound, F.array(here, there)).otherwise(F.array(here))))
    dealt = dealt.select("doc_id", "text", "items", F.col("at.b").alias("b"), F.col("at.guest").alias("guest"))
    w = Window.partitionBy("b").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    out = dealt.select("doc_id", "text", "items", "guest", F.lead("text").over(w).alias("next_text"), F.lead("items").over(w).alias("next_items"))
    return out.filter("guest = 0").drop("guest")


def likeness(a: Column, b: Column, differ: Column) -> Column:
    """Shared digests over all digests of both; 1 for two texts without any."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise((both - differ) / (both + differ)).cast("double")


def compare(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_items) for docs(doc_id, text).

    The edited text is the text with its last third replaced by the first characters of the next document's. Texts are read and shuffled once; what follows works
    on digest arrays. A null text is empty: 0 characters, no digests. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("items", digests(F.col("text")))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    done = with_next(rows).withColumn("edited", edited)
    base = stash(
        done.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            F.col("items").alias("a"),
            digests(F.col("edited")).alias("e"),
            F.coalesce("next_items", F.array().cast("array<bigint>")).alias("x"),
        ),
        "versions",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("b")) for k in ("e", "x"))))
    pairs = base.select("row", "a", kinds.alias("p")).select("row", "p.kind", "a", "p.b")
    differ = differences(pairs, parts).groupBy("row").pivot("kind", ["e", "x"]).agg(F.first(F.col("only_a") + F.col("only_b")))
    versions = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("a")) for k in ("a", "e"))))
    prints = shown(base.select("row", versions.alias("v")).select("row", "v.kind", "v.a"), parts).groupBy("row").pivot("kind", ["a", "e"]).agg(F.first("fingerprint"))
    out = base.join(differ.withColumnsRenamed({"e": "de", "x": "dx"}), "row").join(prints.withColumnsRenamed({"a": "fa", "e": "fe"}), "row", "left")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.coalesce("fa", F.lit("")).alias("fingerprint"),
        F.coalesce("fe", F.lit("")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e"), F.col("de")).alias("near_edited"),
        likeness(F.col("a"), F.col("x"), F.col("dx")).alias("near_next"),
        F.size("a").cast("long").alias("n_items"),
    )
