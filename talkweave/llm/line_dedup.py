"""Line dedup by site-relative frequency.

A line is boilerplate of a host if it stands on more than `ratio` of that host's
pages, and on at least `min_pages` of them. Lines are counted once per page; what
moves is a 16-byte digest per distinct line of a page, combined before the
shuffle. A page has L lines on average, so a host has at most L / ratio
boilerplate lines, which is what returns to its pages as one set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh

RATIO = 0.05
MIN_PAGES = 3


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """host, lines (digests of its boilerplate lines); hosts without any have no row."""
    pages = docs.select(F.col(host_col).alias("host"), _lines(F.col(text_col)).alias("lines"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    filled = F.filter("lines", lambda line: F.trim(line) != "")
    seen = pages.select("host", F.explode(F.array_distinct(F.transform(filled, _digest))).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    shared = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    common = shared.where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return common.groupBy(F.col("c.host").alias("host")).agg(F.collect_set("line").alias("lines"))


def line_dedup(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    dropped_col: str = "n_dropped",
    lines_col: str = "n_lines",
) -> DataFrame:
    """The rows with cleaned texts, and how many lines they had and lost.

    Lines are compared exactly and whole. Defined cases: a line without anything
    but spaces is layout and always stays; a null text stays null, with one
    (empty) line; rows that repeat a document are pages of their own; a null
    host is a host; a page that is all boilerplate becomes an empty text; an
    empty table gives no rows; all other columns are passed through.
    """
    host, found = fresh(docs, "llm_host"), fresh(docs, "llm_lines")
    # Written, so that Spark broadcasts them by their measured size and texts stay where they are.
    sets = cut_lineage(boilerplate(docs, text_col, host_col, ratio, min_pages).toDF(host, found))
    joined = docs.join(sets, docs[host_col].eqNullSafe(sets[host]), "left")
    lines = _lines(F.col(text_col))
    kept = F.when(F.col(found).isNull(), lines).otherwise(
        F.filter(lines, lambda line: (F.trim(line) == "") | ~F.array_contains(F.col(found), _digest(line)))
    )
    clean = fresh(docs, "llm_kept")
    lost = F.size(lines) - F.size(clean)
    return (
        joined.withColumn(clean, kept)
        .withColumns({lines_col: F.size(lines).cast("long"), dropped_col: lost.cast("long")})
        .withColumn(text_col, F.when(F.col(dropped_col) == 0, F.col(text_col)).otherwise(F.array_join(clean, "\n")))
        .drop(host, found, clean)
    )
