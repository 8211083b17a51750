"""Line dedup by site-relative frequency: a line on too large a share of its site's pages is boilerplate there and goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexil.llm.common import free_name, maybe_broadcast, parts, stash, whole

#: A line goes if more than this share of its site's pages hold it.
RATIO = 0.3
BLOCK_END = r"(?i)<(?:/(?:p|div|li|h[1-6]|article|nav|footer|title|ul|table|tr)|br)\s*/?>"


def html_lines(html: Column) -> Column:
    """Text of a page, a line a block: scripts, styles and comments go, tags go, each line is trimmed, empty lines go. Null for null; no lines for an empty page."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    bare = F.regexp_replace(F.regexp_replace(bare, BLOCK_END, "\n"), r"<[^>]*>", "")
    return F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def host(url: Column) -> Column:
    """The part after the scheme up to the first slash, question mark or number sign, in lower case; null for null."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(x))


def boilerplate(rows: DataFrame, ratio: float = RATIO, once: bool = False) -> DataFrame:
    """(site, drop): for rows(site, lines) the hashes of each site's boilerplate lines as one array, a row a site that has any.

    A line is boilerplate if it repeats, on more than one page, and more than `ratio` of the site's pages hold it. A page counts a line once; with `once`, pages of
    equal lines are one page, so that copies of a page don't make its own text boilerplate. Pairs (site, line) are counted by an aggregate that sums up in each
    task before the shuffle. More than 1 / ratio times a page's mean number of lines can't pass, so the arrays are short. A null site is a site of its own.
    """
    held = rows.select("site", F.array_distinct(_hashes(F.col("lines"))).alias("h"), F.xxhash64("lines").alias("page"))
    if once:
        held = held.groupBy("site", "page").agg(F.first("h").alias("h"))
    pages = held.groupBy("site").agg(F.count("*").alias("pages"))
    often = held.select("site", F.explode("h").alias("h")).groupBy("site", "h").agg(F.count("*").alias("n")).filter("n > 1")
    both = often.alias("o").join(pages.alias("p"), F.expr("o.site <=> p.site"))
    return both.filter(F.col("n") > F.col("pages") * F.lit(ratio)).groupBy(F.col("o.site").alias("site")).agg(F.sort_array(F.collect_list("h")).alias("drop"))


def _kept(rows: DataFrame, ratio: float, once: bool) -> DataFrame:
    """rows(row, site, lines) with kept: the lines that aren't their site's boilerplate, in order, repeats included; null for null.

    The table of sites with boilerplate is written, counted and broadcast only if it fits; a larger one is joined by a shuffle. A line is looked up among those of
    the page that are boilerplate, which an intersection by hashing finds first.
    """
    drop = stash(boilerplate(rows.select("site", "lines"), ratio, once), "boilerplate")
    n, hashes = drop.agg(F.count("*"), F.coalesce(F.sum(F.size("drop")), F.lit(0))).first()
    side = maybe_broadcast(drop, 1, 100 * n + 8 * hashes).withColumnRenamed("site", "own")
    out = rows.join(side, F.col("site").eqNullSafe(F.col("own")), "left").withColumn("drop", F.array_intersect("drop", _hashes(F.col("lines"))))
    kept = F.when(F.coalesce(F.size("drop"), F.lit(0)) <= 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), F.xxhash64(x))))
    return out.select("row", "site", "lines", kept.alias("kept"))


def clean_pages(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """pages(page_id, url, html, ...) with site, lines and kept_lines, grouped by host.

    A null url is a site of its own, a url without a host another; null html has null lines, an empty or very long page its lines, whole. Repeated rows are
    pages like others. A line that only one page of a site holds stays, whatever its share. Columns of the input that have one of the three names stay, and
    the result's is called name_2. An empty table gives no rows.
    """
    rows = pages.select(whole(pages), host(F.col("url")).alias("site"), html_lines(F.col("html")).alias("lines"))
    named = [F.col(c).alias(free_name(n, pages.columns)) for c, n in (("site", "site"), ("lines", "lines"), ("kept", "kept_lines"))]
    return _kept(rows, ratio, False).select(*parts(pages), *named)


def clean_documents(docs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """docs(text, source, ...) with the boilerplate lines of their source taken out of text; n_chars follows where text changed. Rows and other columns stay.

    Documents have no host: the source stands for it, and a null source is one. Documents of equal text count once, since a group of copies is near-dedup's to
    thin out, and its lines aren't boilerplate. A document of which every line is boilerplate keeps its row with an empty text. Null texts stay null, empty and
    very long ones are whole; an empty table gives no rows.
    """
    rows = docs.select(whole(docs), F.col("source").alias("site"), F.split("text", "\n").alias("lines"))
    changed = F.size("kept") < F.size("lines")
    text = F.when(changed, F.concat_ws("\n", "kept")).otherwise(F.col("row.text"))
    put = {"text": text}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return _kept(rows, ratio, True).select(*(put.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
