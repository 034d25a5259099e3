"""URL filters: explicit rules first, then a path-template tree per host.

Paths become branches: runs of digits, long hex strings and UUIDs are variable
by their shape. Branches are counted per host before anything else, so a host
with a third of all pages is as many rows as it has branches. The tree is then
generalised one depth at a time: siblings are clustered by their labelled share
of bad pages, so that none differs from the rest of its cluster by more than
chance leaves at `z` standard errors; a cluster of several siblings becomes one
wildcard. Siblings with few pages start as one member, which those that differ
leave; siblings without a label go with them. Each template is judged by its labelled purity, smoothed towards the
share of all labelled pages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: (host, path, verdict)
Rule = tuple[str, str, str]

MIN_PAGES = 20
Z = 2.5
STRENGTH = 10.0
MIN_PURITY = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, else nulls. The list is an expression: some hundred rules."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for of, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        name = F.when(fits, F.lit(of + start)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def path_shape(path: Column) -> Column:
    """Segments of a path, all of them, with what varies by its shape as wildcards."""
    variable = F.regexp_replace(path, r"(?i)(?<![0-9a-z])(?:[0-9a-f]{16,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})(?![0-9a-z])", "{h}")
    return F.split(F.regexp_replace(variable, r"[0-9]+", "{n}"), "/")


def _sums(n: str, labelled: str, bad: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in (n, labelled, bad)]


def differs(labelled: int, bad: int, others: int, bad_others: int, z: float) -> bool:
    """Whether two bad shares differ by more than chance: exact tail (Fisher) against the normal tail at z."""
    total, bads = labelled + others, bad + bad_others
    mean = labelled * bads / total
    if not labelled or not others or bads in (0, total):
        return False
    if min(labelled, others) * min(bads, total - bads) / total > 25:
        error = math.sqrt(mean * (1 - bads / total) * others / (total - 1))
        return abs(bad - mean) - 0.5 > z * error
    # The tail from `bad` away from the mean, by the ratios of its terms.
    if bad < mean:  # count the good ones instead, so that the tail goes up
        bad, bads = labelled - bad, total - bads
    k = np.arange(bad, min(labelled, bads), dtype=float)
    ratios = (bads - k) * (labelled - k) / ((k + 1) * (total - bads - labelled + k + 1))

    def choose(n: int, r: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    first = math.exp(choose(bads, bad) + choose(total - bads, labelled - bad) - choose(total, labelled))
    return first * (1 + np.cumprod(ratios).sum()) < 0.5 * math.erfc(z / math.sqrt(2))


def _parted(units: list[tuple[int, int, int]], z: float) -> list[list[int]]:
    """Positions of (labelled, bad, members) in clusters, by rising share.

    A cluster is cut where two shares explain it best, as long as one of its
    members differs from the rest taken together.
    """
    order = sorted(range(len(units)), key=lambda i: (units[i][1] / units[i][0], units[i]))
    done, waiting = [], [order]
    while waiting:
        held = waiting.pop()
        if not held:
            continue
        l, b, m = np.array([units[i] for i in held], np.int64).T
        all_l, all_b = np.cumsum(l * m), np.cumsum(b * m)
        n, k = int(all_l[-1]), int(all_b[-1])
        cuts = np.flatnonzero(b[1:] * l[:-1] != b[:-1] * l[1:])
        if not len(cuts) or not any(differs(x, y, n - x, k - y, z) for x, y in zip(l.tolist(), b.tolist(), strict=True)):
            done.append(held)
            continue

        def likelihood(n, k):
            return k * np.log(np.maximum(k, 1) / n) + (n - k) * np.log(np.maximum(n - k, 1) / n)

        left_l, left_b = all_l[cuts], all_b[cuts]
        best = int(cuts[np.argmax(likelihood(left_l, left_b) + likelihood(n - left_l, k - left_b))]) + 1
        waiting += [held[best:], held[:best]]
    return done


def sibling_clusters(kinds: list[tuple[bool, int, int, int]], z: float) -> list[str | None]:
    """(rare, labelled, bad, members) of one node -> wildcard of each kind; None keeps its own name.

    Rare siblings are together one member until they differ from what they are
    with; so no sibling stays in a cluster whose rest it differs from.
    """
    common = {i for i, (rare, labelled, _, _) in enumerate(kinds) if rare and labelled}
    single = [i for i, (rare, labelled, _, _) in enumerate(kinds) if labelled and not rare]
    while True:
        units = [kinds[i][1:] for i in single]
        if common:
            units.append((sum(kinds[i][1] * kinds[i][3] for i in common), sum(kinds[i][2] * kinds[i][3] for i in common), 1))
        clusters = _parted(units, z)
        home = next((c for c in clusters if len(single) in c), [])
        n, k = (sum(units[u][x] * units[u][2] for u in home) for x in (0, 1))
        leave = {i for i in common if differs(kinds[i][1], kinds[i][2], n - kinds[i][1], k - kinds[i][2], z)}
        if not leave:
            break
        common -= leave
        single += sorted(leave)
    names: list[str | None] = ["*"] * len(kinds)
    if len(clusters) > 1:
        for number, cluster in enumerate(clusters):
            if cluster is not home:
                alone = sum(units[u][2] for u in cluster) == 1
                for u in cluster:
                    names[single[u]] = None if alone else f"*{number}"
    return names


def _clusters(z: float):
    """host, template, kinds of siblings -> each kind with its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out: list[tuple] = []
                for host, template, kinds in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    of = sorted((k["rare"], k["labelled"], k["bad"], k["members"]) for k in kinds)
                    out += [(host, template, *k[:3], name) for k, name in zip(of, sibling_clusters(of, z), strict=True)]
                types = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
                cols = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays(cols, names=["host", "template", "rare", "labelled", "bad", "name"])

    return run


def _sibling_names(child: DataFrame, z: float, min_pages: int) -> DataFrame:
    """host, template, part, low, high -> name and how many segments it takes.

    A node is gathered as its different counts, which are few however many siblings have
    them. A branch with a name of its own goes on to where its paths part.
    """
    node, kind = ["host", "template"], ["rare", "labelled", "bad"]
    child = child.withColumn("rare", (F.col("n") < min_pages) & (F.col("labelled") > 0))
    kinds = child.groupBy(*node, *kind).agg(F.count("*").alias("members"))
    nodes = kinds.groupBy(*node).agg(F.collect_list(F.struct(*kind, "members")).alias("kinds"), F.sum("members").alias("siblings"))
    named = nodes.where("siblings > 1").drop("siblings").mapInArrow(
        _clusters(z), "host string, template string, rare boolean, labelled long, bad long, name string"
    )
    same = F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y))
    until = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")
    taken = F.when(F.col("name").isNull(), until).otherwise(F.lit(1))
    every = child.join(named, [*node, *kind], "left").withColumn("taken", taken)
    name = F.coalesce("name", F.array_join(F.slice("low", F.lit(1), F.col("taken")), "/"))
    return every.select(*node, "part", name.alias("name"), "taken")


def template_tree(branches: DataFrame, z: float = Z, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, shape (array), n, labelled, bad -> with `template` added. Nulls as in the caller: none.

    Rounds go on until no branch has a further segment; there are as many as branches part below each other.
    """
    node = ["host", "template"]
    going = cut_lineage(branches.withColumn("template", F.lit("")).withColumn("rest", F.col("shape")))
    done = going.where(F.size("rest") == 0)
    level = 0
    while not (here := going.where(F.size("rest") > 0).withColumn("part", F.element_at("rest", 1))).isEmpty():
        child = here.groupBy(*node, "part").agg(*_sums("n", "labelled", "bad"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        names = _sibling_names(child, z, min_pages)
        longer = F.concat_ws("/", F.when(F.lit(level > 0), F.col("template")), F.col("name"))
        step = here.join(names, [*node, "part"]).withColumn("template", longer)
        rest = F.slice("rest", F.col("taken") + 1, F.size("rest"))
        going = cut_lineage(step.withColumn("rest", rest).select(*going.columns))
        done = done.unionByName(going.where(F.size("rest") == 0))
        level += 1
    return done.drop("rest")


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[Rule] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    z: float = Z,
    min_pages: int = MIN_PAGES,
    strength: float = STRENGTH,
    min_purity: float = MIN_PURITY,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: one row per page.

    labels: id, bad (0 or 1). Where a rule fits, its verdict holds; a page under
    no rule is blocked if its template's smoothed purity is below `min_purity`.
    Defined cases: a null url or one without `://` has empty host and path, as
    a host of its own; null labels and labels of unknown pages are not used;
    several labels of a page count as bad if one is; templates without labels
    get the share of all labelled pages, or 1 if there are none; rows that
    repeat a page are pages of their own; an empty table gives no rows; other
    columns are not read.
    """
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    parts = parts.withColumn("shape", path_shape(F.col("path")))
    known = labels.select(F.col(labels.columns[0]).alias("page_id"), F.col(labels.columns[1]).cast("long").alias("bad"))
    known = known.where("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    marked = parts.join(known, "page_id", "left")
    branches = marked.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    grown = template_tree(branches, z, min_pages)
    total = grown.agg(
        F.coalesce((F.sum("labelled") - F.sum("bad")) / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(1.0)).alias("prior")
    )
    prior = float(total.first()["prior"])
    judged = grown.groupBy("host", "template").agg(*_sums("n", "labelled", "bad"))
    good = F.col("labelled") - F.col("bad")
    judged = judged.select(
        "host", "template", ((good + strength * prior) / (F.col("labelled") + strength)).alias("purity")
    )
    verdicts = grown.select("host", "shape", "template").join(judged, ["host", "template"])
    rule, says = match_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < min_purity, F.lit("block")).otherwise(F.lit("allow"))
    return parts.join(verdicts, ["host", "shape"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"), "template", "purity"
    )
