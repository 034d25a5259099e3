import random

from talkweave.llm.queries import QUERIES, URL_RULES
from talkweave.llm.url_filter import filter_urls

SCHEMA = "page_id long, url string, html string, host int, template string, bad string"
LABELS = "id long, bad int"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, u, None, 1, "t", "b") for i, u in rows], SCHEMA)


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    for c in "?#":
        path = path.split(c)[0]
    best = max(((len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
    return host, path, best[1], best[2]


def test_hosts_paths_and_rules(spark):
    urls = [
        "http://A.Example.COM/en/7x?q#f", "https://example.com/en/6", "ftp://com/en/", "http://xcom/en/1", "http://x.net/de/9", "http://a.example.net/de/88",
        "http://b.example.net/de/9", "http://u.org/es/", "http://org/es", "no scheme", "", None, "://", "a://b://c/d", "http://h?x/y", "http://h#x/y",
        "http://h/a//b/?x://", "http://É.com/en/Ä", "http://h\n.com/en/\nx",
    ]
    rows = list(enumerate(urls)) + [(3, urls[3]), (None, urls[0])]
    none = spark.createDataFrame([], LABELS)
    got = filter_urls(frame_of(spark, rows), none, URL_RULES).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *plain(u)) for i, u in rows), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got), key=str) == want
    assert all(r.verdict == "allow" for r in got if r.rule is None)


def test_bad_branches_are_split_off_and_blocked(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(3000):
        part = rng.choice(["news", "blog", "shop", "spam"])
        rows.append((i, f"http://hot.example/{part}/{rng.randint(0, 10**9)}/{rng.choice(['a', 'b', 'c'])}.html"))
        if i % 3 == 0:
            labels.append((i, int(rng.random() < (0.95 if part == "spam" else 0.1))))
    rows += [(5000 + i, f"http://rare.example/x{i}/y") for i in range(30)] + [(6000, "http://rare.example/" + "/".join("abcdefghijklm"))]
    labels += [(9999, 1), (None, 1), (0, None), (1, 0), (1, 0)]
    got = filter_urls(frame_of(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    for r in got:
        bad = "/spam/" in r.path
        assert r.verdict == ("block" if bad else "allow")
        if r.host == "hot.example":
            assert r.template == ("/spam/{n}/*" if bad else "/*0/{n}/*")
    assert len({r.template for r in got if r.host == "rare.example"}) <= 3
    assert len(got) == len(rows)


def test_empty_tables(spark):
    assert filter_urls(frame_of(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_query_rules_against_brute_force(spark, sf):
    want = {r.page_id: plain(r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op9_url_filter"](spark, sf).collect():
        host, path, rule, verdict = want[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def branch(rows, labels, path, pages, labelled, bad, host="h.example"):
    for k in range(pages):
        i = len(rows)
        rows.append((i, f"http://{host}/{path}/{k}"))
        if k < labelled:
            labels.append((i, int(k < bad)))


def verdicts(spark, rows, labels):
    out = {}
    for r in filter_urls(frame_of(spark, rows), spark.createDataFrame(labels, LABELS)).collect():
        out.setdefault((r.host, r.path.rsplit("/", 1)[0]), set()).add(r.verdict)
    return out


def test_branches_that_differ_are_not_merged(spark):
    rows, labels = [], []
    for k in range(21):  # neighbours are alike, the ends are not
        branch(rows, labels, "g" + chr(97 + k), 100, 100, 5 * k, "graded.example")
    branch(rows, labels, "good", 1000, 1000, 50, "bridge.example")
    branch(rows, labels, "thin", 30, 1, 0, "bridge.example")
    branch(rows, labels, "lean", 30, 1, 1, "bridge.example")
    branch(rows, labels, "bad", 1000, 1000, 950, "bridge.example")
    for k in range(10):
        branch(rows, labels, "n" + chr(97 + k), 60, 60, 3, "few.example")
    branch(rows, labels, "spam", 15, 15, 15, "few.example")
    for k in range(150):  # rare siblings without a name of their own, worse than the large one
        branch(rows, labels, "r" + "abcdefghij"[k // 15] + "abcdefghijklmno"[k % 15], 1, 1, 1, "rare.example")
    branch(rows, labels, "main", 400, 400, 20, "rare.example")
    got = verdicts(spark, rows, labels)
    for k in range(21):
        if abs(k - 10) > 3:
            assert got["graded.example", "/g" + chr(97 + k)] == {"block" if k > 10 else "allow"}
    assert got["bridge.example", "/good"] == {"allow"} and got["bridge.example", "/bad"] == {"block"}
    assert got["few.example", "/spam"] == {"block"} and got["few.example", "/na"] == {"allow"}
    assert got["rare.example", "/raa"] == {"block"} and got["rare.example", "/main"] == {"allow"}


def test_bad_sections_are_found_at_any_depth(spark):
    rows, labels = [], []
    start = "blog/en/news/{}/more/of/the/way/" + "/".join("abcdefghijkl")
    for k in range(60):
        slug = "abcdefghij"[k // 10] + "klmnopqrst"[k % 10]
        for part in ("spam", "fine"):
            branch(rows, labels, f"{start.format(2000 + k % 3)}/{part}/{slug}", 1, 1, int(part == "spam"))
    branch(rows, labels, "far/" + "/".join(["x"] * 400) + "/one", 1, 0, 0, "far.example")
    branch(rows, labels, "far/" + "/".join(["x"] * 400) + "/two", 1, 0, 0, "far.example")
    got = filter_urls(frame_of(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.verdict == ("block" if "/spam/" in r.path else "allow")
        if "/spam/" in r.path:
            assert r.template == f"/blog/en/news/{{n}}/more/of/the/way/{'/'.join('abcdefghijkl')}/spam/*/{{n}}"
    assert {r.template for r in got if "/far/" in r.path} == {"/far/" + "/".join(["x"] * 400) + "/*/{n}"}
