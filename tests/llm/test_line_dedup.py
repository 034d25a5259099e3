from collections import Counter, defaultdict

from compare import difference, duck, duck_rows, spark_rows

from talkweave.llm.line_dedup import line_dedup
from talkweave.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, source string, lines string, llm_lines int, llm_host int"


def plain(rows, ratio, least):
    pages, seen = Counter(), defaultdict(Counter)
    for _, text, host in rows:
        pages[host] += 1
        seen[host].update({x for x in (text or "").split("\n") if x.strip(" ")})
    out = []
    for i, text, host in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (seen[host][x] >= least and seen[host][x] > ratio * pages[host])]
        out.append((i, text if len(kept) == len(lines) else "\n".join(kept), host, len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_defined_cases_and_brute_force(spark):
    rows = [(i, f"head\nbody {i}\n\nfoot {i % 9}\nsame here", "hot") for i in range(60)]
    rows += [(100, "head\nhead\nhead", "hot"), (101, None, "hot"), (102, "", None), (103, "foot\r", None), (104, "a\nfoot\r", None), (105, "foot\r\n", None)]
    rows += [(106, "same here", "cold"), (107, "same here", "cold"), (108, "x " * 200_000 + "\nhead", "hot"), (108, "x\nhead", "hot"), (None, "head", "hot")]
    frame = spark.createDataFrame([(i, t, h, "x", 1, 2) for i, t, h in rows], SCHEMA)
    for ratio, least in ((0.05, 3), (0.5, 1), (0.9, 3)):
        clean = line_dedup(frame, ratio=ratio, min_pages=least)
        assert clean.columns == [*frame.columns, "n_lines", "n_dropped"]
        got = sorted(((r.doc_id, r.text, r.source, r.n_lines, r.n_dropped) for r in clean.collect()), key=str)
        assert got == plain(rows, ratio, least)
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_sql(spark, sf):
    got = spark_rows(QUERIES["op10_line_dedup"](spark, sf))
    assert difference(got, duck_rows(duck(sf), SQL["op10_line_dedup"])) is None
