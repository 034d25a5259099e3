"""Mix sources to target weights with Efraimidis-Spirakis keys.

A document of quality w draws the exponential key -ln(u) / w, u by hash of its
id, its text and its number among equal rows, and a source is read in the order of its keys. Targets are water-filled:
shares by weight, none above `max_epochs` times its source. Complete epochs come
first; the rest of a target is a run of smallest keys. Keys are dealt into `buckets` ranges that hold equal parts of the
exponential law, sizes are summed by range before anything moves, and only the
one range of a source that the target falls into is sorted. The run of keys stops
before the first document that does not fit; the gap that this leaves is closed
by one document more, the one whose size comes nearest to it, if that is nearer
than leaving it open. What comes back to the documents is one row per source
with the last key taken and the closing document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import count_words, unit

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 42
BUCKETS = 16_384
SALTS = 64


def text_quality(text: Column) -> Column:
    """0.25 to 1, by the share of a text's characters that are letters."""
    letters = F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))
    share = F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))
    return F.lit(0.25) + F.lit(0.75) * share


def _key(identifier: Column, quality: Column, seed: int) -> Column:
    safe = F.when(quality > 0, quality).otherwise(F.lit(1e-9))
    return -F.log(unit(identifier, seed)) / safe


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """source, source_size -> source, source_size, target; works on one row per source.

    With caps sorted by cap / weight, the level that the uncapped sources reach
    is known from running sums, so no rounds of resharing are needed.
    """
    # One row per source: a single task sees a few bytes for each.
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    steps = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(steps, (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = rows.withColumn("level", level).withColumn("reached", F.col("level") < F.col("cap") / F.col("weight"))
    first = F.min(F.when(F.col("reached"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(whole)
    return levels.withColumn("final", first["level"]).select(
        "source",
        "source_size",
        F.when(F.col("final").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("final") * F.col("weight")))
        .alias("target"),
    )


def mix_plan(
    sized: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, source, size, key -> one row per source: target, epochs, and what its rest takes."""
    part = F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.lit(buckets)).cast("int")
    rows = sized.withColumn("bucket", part)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = cut_lineage(sums)
    aims = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    size = F.col("source_size").cast("double")
    aims = cut_lineage(
        aims.withColumn("epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * size)
    )
    running = Window.partitionBy("source").orderBy("bucket")
    aim = aims.select(F.col("source").alias("of"), "rest")
    sums = sums.withColumn("upto", F.sum("words").over(running))
    edges = (
        sums.join(aim, sums["source"].eqNullSafe(aim["of"]))
        .where((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
        .select("of", F.col("bucket").alias("edge"), (F.col("upto") - F.col("words")).alias("before"), "rest")
    )
    inside = rows.join(edges, rows["source"].eqNullSafe(edges["of"]) & (rows["bucket"] == edges["edge"]))
    inside = inside.groupBy("of", "edge", "before", "rest", "key", "doc_id").agg(F.sum("size").alias("words"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("of", "edge").orderBy("key", "doc_id"))
    fitting = inside.withColumn("upto", upto).where(F.col("upto") <= F.col("rest"))
    last = fitting.groupBy("of").agg(F.max(F.struct("key", "doc_id", "upto")).alias("last"))
    marks = edges.join(last.withColumnRenamed("of", "who"), F.col("of").eqNullSafe(F.col("who")), "left").select(
        "of", "edge", "last", (F.col("rest") - F.coalesce(F.col("last.upto"), F.col("before"))).alias("gap")
    )
    plan = cut_lineage(
        aims.join(marks, aims["source"].eqNullSafe(F.col("of")), "left").select(
            F.col("source").alias("of"), "source_size", "target", "epochs", "rest", "edge", "last", "gap"
        )
    )
    left = with_plan(rows, plan).where(
        (F.col("gap") > 0) & (_in_run(F.col("bucket"), F.col("key"), F.col("doc_id")) == 0)
    )
    off = F.abs(F.col("size") - F.col("gap"))
    closing = (
        left.where(off < F.col("gap"))
        .groupBy("of")
        .agg(F.min(F.struct(off.alias("off"), "key", "doc_id")).alias("closing"))
        .select(F.col("of").alias("who"), "closing")
    )
    # Written, so that its size is known where it meets the rows.
    return cut_lineage(plan.join(closing, plan["of"].eqNullSafe(closing["who"]), "left").drop("who"))


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's line of the plan. A source is met in SALTS places, so a hot one is no hot task."""
    salt = F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int")
    many = plan.withColumn("there", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", salt)
    met = salted["source"].eqNullSafe(many["of"]) & (salted["salt"] == many["there"])
    return salted.join(many, met).drop("salt", "there")


def _in_run(bucket: Column, key: Column, identifier: Column) -> Column:
    """1 if the run of smallest keys holds a document, else 0."""
    # Without an edge the rest is 0, or every document is needed to reach it.
    tie = identifier.eqNullSafe(F.col("last.doc_id")) | F.coalesce(identifier <= F.col("last.doc_id"), identifier.isNull())
    inside = F.col("last").isNotNull() & ((key < F.col("last.key")) | ((key == F.col("last.key")) & tie))
    return (
        F.when(F.col("edge").isNull(), F.col("rest") > 0)
        .when(bucket != F.col("edge"), bucket < F.col("edge"))
        .otherwise(inside)
        .cast("long")
    )


def _stored(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column | None, *more: Column) -> DataFrame:
    """What the draw needs of each row, written once, so a row keeps its place in later jobs."""
    quality = text_quality(F.col(text_col)) if quality is None else quality
    return cut_lineage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            count_words(F.col(text_col)).alias("size"),
            quality.alias("quality"),
            F.xxhash64(F.col(text_col)).alias("print"),
            F.monotonically_increasing_id().alias("place"),
            *more,
        )
    )


def _numbers(stored: DataFrame) -> DataFrame:
    """place, nth: rows with equals, numbered among them.

    Equal rows are counted by the part of the table that holds them and numbered
    inside it, so a row that makes up a third of the table is no hot task.
    """
    part = F.shiftright("place", 33).alias("part")
    same = ["doc_id", "source", "print"]
    counts = stored.groupBy(*same, part).agg(F.count("*").alias("n"))
    alike = Window.partitionBy(*same)
    before = F.sum("n").over(alike.orderBy("part")) - F.col("n")
    several = counts.select("*", before.alias("before"), F.sum("n").over(alike).alias("rows")).where("rows > 1")
    several = cut_lineage(several.select(*[F.col(c).alias(f"of_{c}") for c in (*same, "part")], "before"))
    rows = stored.select(*same, part, "place")
    met = [rows[c].eqNullSafe(several[f"of_{c}"]) for c in same]
    nth = F.row_number().over(Window.partitionBy(*same, "part").orderBy("place"))
    numbered = rows.join(several, [*met, rows["part"] == several["of_part"]])
    return cut_lineage(numbered.select("place", (F.col("before") + nth).alias("nth")))


def _copies(stored: DataFrame, weights, share: float, max_epochs: int, seed: int, buckets: int) -> DataFrame:
    """The stored rows with source_size, target and the number of times that the mix takes each."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = F.concat_ws(" ", name, F.col("print").cast("string"), F.coalesce("nth", F.lit(1)).cast("string"))
    sized = stored.join(_numbers(stored), "place", "left").withColumn("key", _key(drawn, F.col("quality"), seed))
    plan = mix_plan(sized.select("doc_id", "source", "size", "key"), weights, share, max_epochs, buckets)
    bucket = F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.lit(buckets)).cast("int")
    closes = (F.col("key") == F.col("closing.key")) & F.col("doc_id").eqNullSafe(F.col("closing.doc_id"))
    run = _in_run(bucket, F.col("key"), F.col("doc_id"))
    copies = F.col("epochs") + F.greatest(run, F.coalesce(closes, F.lit(False)).cast("long"))
    return with_plan(sized, plan).withColumn("copies", copies)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row per input row.

    Defined cases: a null text has size 0, so nothing is taken from it; a null
    source is a source and comes last; rows that repeat a document id, null ids
    included, draw a key each, by their text and, where that repeats too, by their
    number among equal rows; sources without words have target 0; an empty table
    gives no rows; other columns are not read. Reruns agree: all draws are hashes,
    and equal rows are alike whichever of them has a number.
    """
    rows = _copies(_stored(docs, id_col, text_col, source_col, quality), weights, share, max_epochs, seed, buckets)
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The rows of documents as the mix takes them: left out, once, or once per epoch; same columns.

    Each row is taken as `mix_sources` says. Whole rows are written beside their
    draw, so texts meet one row per source and are not exchanged, unless many rows repeat.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    stored = _stored(docs, id_col, text_col, source_col, quality, whole)
    taken = _copies(stored, weights, share, max_epochs, seed, buckets).where("copies > 0")
    each = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("each"))
    return each.select("row.*")
