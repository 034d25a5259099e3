import base64
import datetime as dt
import hashlib
import hmac

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.functions import clock, identity, scores, text, vectors
from talkweave.operators import filters


def one(spark, schema, *values, **columns):
    df = spark.createDataFrame([values], schema)
    return df.select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"y" * 100])
def test_opaque_id_is_hmac(spark, key):
    values = [str(i) for i in range(100)] + ["é", "a b", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r.v: r.i for r in df.select("v", identity.opaque_id("person", F.col("v"), key, 22).alias("i")).collect()}
    for v in values:
        digest = hmac.new(key, f"person:{v}".encode(), hashlib.sha256).digest()
        assert got[v] == "person_" + base64.urlsafe_b64encode(digest).decode().rstrip("=")[:22]


def test_epochs(spark):
    df = spark.createDataFrame([(700_000_000,), (700_000_000_123_456_789,), (None,), (-5,)], "d long")
    got = [r[0] for r in df.select(clock.iso_text(clock.normalize_epoch(F.col("d")))).collect()]
    assert got == ["2023-03-08T20:26:40.000Z"] * 2 + [None, "2000-12-31T23:59:55.000Z"]


def test_time_arguments():
    assert clock.iso_argument("2024-01-01T02:00:00+02:00", "since") == dt.datetime(2024, 1, 1)
    assert clock.iso_argument("2024-01-01T00:00:00.250Z", "since").microsecond == 250_000
    assert clock.iso_argument("", "since") is None
    for bad in ("yesterday", "2024-01-01", "2024-13-01T00:00:00Z"):
        with pytest.raises(ValueError, match="until"):
            clock.iso_argument(bad, "until")


def test_identifiers(spark):
    values = ["(555) 010-9999", "+1 555 010 9999", " A@B.org ", "12", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(identity.normalize_identifier(F.col("v"))).collect()]
    assert got == ["15550109999", "15550109999", "a@b.org", "12", ""]


def test_text(spark):
    row = one(
        spark, "a string, b string, c string", "  Hi ", None, "x" * 70,
        both=text.content(F.lit("Re"), F.col("a")), none=text.content(F.col("b"), F.col("b")),
        title=text.clip_title(F.concat(F.lit("a  \n b "), F.col("c"))),
        short=text.clip_title(F.lit(" a \t b ")),
        answer=text.normalize_answer(F.lit("Done.Next one.\n\n\n\nEnd. ok.no")),
        masked=text.mask_links(F.lit("go https://x.org/a?b and www.y.org, now")),
        file=text.private_attachment_name(F.lit("/tmp/a.b/IMG_1.HEIC ")),
        bare=text.private_attachment_name(F.lit("README")),
        blank=text.private_attachment_name(F.lit("  ")),
    )
    assert row.both == "Re —   Hi".rstrip() and row.none == ""
    assert row.title == "a b " + "x" * 57 + "…" and row.short == "a b"
    assert row.answer == "Done. Next one.\n\nEnd. ok.no"
    assert row.masked == "go http and http now"
    assert (row.file, row.bare, row.blank) == ("[attachment].heic", "[attachment]", None)


def test_query_tokens():
    assert text.query_tokens("Crème  Brûlée! a B2 crème 100%_x") == ["creme", "brulee", "b2", "100"]
    assert text.query_tokens("ﬁne") == ["fine"]
    assert text.query_tokens("a b !") == []
    many = " ".join(f"w{i}" for i in range(50))
    assert len(text.query_tokens(many)) == 50 and len(text.query_tokens(many, 32)) == 32
    with pytest.raises(ValueError):
        text.required_query(" ")
    with pytest.raises(ValueError):
        text.required_query("x" * 501)


def test_fold(spark):
    df = spark.createDataFrame([("Crème Brûlée ÅNGSTRÖM é",)], "t string")
    assert df.select(text.fold_text(F.col("t"))).first()[0] == "creme brulee angstrom e"
    assert df.select(text.tokens(F.col("t"))).first()[0] == ["creme", "brulee", "angstrom", "e"]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=n)]) for i, n in enumerate([8, 8, 5, 12, 0])]
    df = spark.createDataFrame([*rows, (9, None)], "id int, v array<float>")
    query = [float(x) for x in rng.normal(size=8)]
    got = df.select(
        "id", vectors.cosine(F.lit(query), F.col("v")).alias("a"), vectors.cosine_to(query)(F.col("v")).alias("b")
    ).collect()
    for r, (_, v) in zip(got, [*rows, (9, None)]):
        if v is None:
            assert r.a is None and r.b is None
            continue
        n = min(len(v), 8)
        a, b = np.array(query[:n]), np.array(v[:n])
        want = float(a @ b / max(1e-12, np.sqrt((a @ a) * (b @ b)))) if n else 0.0
        assert r.a == pytest.approx(want, abs=1e-9) and r.b == pytest.approx(want, abs=1e-9)
    fitted = df.filter("id in (0, 4)").select(vectors.fit_vector(F.col("v"), 6)).collect()
    head = np.array(rows[0][1][:6])
    assert fitted[0][0] == pytest.approx(list(head / np.linalg.norm(head)), abs=1e-6)
    assert fitted[1][0] == [0.0] * 6


def test_scores(spark):
    row = one(
        spark, "a double, b double, c double", 1000.0, 1001.0, 999.0,
        s=scores.tone_from_logits(F.col("a"), F.col("b"), F.col("c")),
    ).s
    e = np.exp(np.array([0.0, 1.0, -1.0]))
    assert [row.negative, row.neutral, row.positive] == pytest.approx(list(e / e.sum()))
    ties = {(0.5, 0.5, 0.0): "negative", (0.5, 0.0, 0.5): "negative", (0.0, 0.5, 0.5): "neutral", (0.1, 0.2, 0.7): "positive"}
    df = spark.createDataFrame(list(ties), "a double, b double, c double")
    got = [r[0] for r in df.select(scores.dominant(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == list(ties.values())


def test_limits_and_filters(spark):
    assert filters.clamp_limit(None, 1, 100, 25) == 25 and filters.clamp_limit(0, 1, 100, 25) == 1
    assert filters.clamp_limit(999, 1, 100, 25) == 100
    with pytest.raises(ValueError):
        filters.strict_limit(0, 10, 5)
    df = spark.createDataFrame(
        [(1, ["a", "b"], "100%"), (2, ["b"], "1000"), (3, [], "x_y")], "id int, person_ids array<string>, t string"
    )
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(df.filter(filters.people_match(F.col("person_ids"), ["a", "b", "a"], "all"))) == [1]
    assert ids(df.filter(filters.people_match(F.col("person_ids"), ["a", "b"]))) == [1, 2]
    assert ids(df.filter(filters.any_contains(["t"], "0%"))) == [1]
    assert ids(df.filter(filters.any_contains(["t"], "X_Y"))) == [3]
