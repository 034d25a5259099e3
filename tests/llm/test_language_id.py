import random
import zlib

import numpy as np

from talkweave.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int"
WORDS = {"aa": "the and of tion ing", "bb": "der und die heit lich", "cc": "que los ción ado el"}


def made(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choices(WORDS[k].split(), k=2)) for _ in range(30)), k, None, 1) for i in range(n) for k in [sorted(WORDS)[i % 3]]]


def plain_kernel(a, b):
    def grams(text):
        codes = "".join(c if c.isalpha() else " " for c in text.lower())
        while "  " in codes:
            codes = codes.replace("  ", " ")
        out = set()
        for n in range(1, L.ORDERS + 1):
            for i in range(len(codes) - n + 1):
                key = n
                for c in codes[i : i + n]:
                    key = (key << 21) % 2**64 ^ ord(c)
                out.add(key * 0x9E3779B97F4A7C15 % 2**64 >> (64 - L.BITS))
        return out

    x, y = grams(a), grams(b)
    return len(x & y) / (len(x) * len(y)) ** 0.5


def test_presences_are_the_kernel(monkeypatch):
    texts = ["The  quick; brown\nfox", "Der Öl-Fuchs 123 braun", "ångström x", "a", "quick " * 40]
    for piece in (L.CHARS, 7):
        monkeypatch.setattr(L, "CHARS", piece)
        rows, known = L.presences(texts)
        assert known.all()
        rows = rows.astype(float)
        own = np.sqrt(rows.sum(axis=1))
        got = rows @ rows.T / own[:, None] / own
        want = [[plain_kernel(a, b) for b in texts] for a in texts]
        assert np.allclose(got, want)


def test_nystroem_with_all_landmarks_is_kernel_ridge():
    data = made(30)
    sets = [np.flatnonzero(L.presences([t])[0][0]).tolist() for _, t, *_ in data]
    samples = [(k, s) for (_, _, k, *_), s in zip(data, sets, strict=True)]
    model = L.fit(samples, landmarks=100, ridge=1e-9)
    best, score = model.score([t for _, t, *_ in data])
    assert [model.languages[b] for b in best] == [k for k, _ in samples]
    assert (score > 0.99).all()  # without a penalty the regression goes through its targets


def test_defined_cases(spark):
    rows = made(60) + [(100, None, "aa", None, 1), (101, " 12 ?!", "bb", None, 1), (102, "", None, None, None)]
    rows += [(103, "the and of tion " * 90_000, None, None, None), (None, "und die heit lich", "bb", None, None), (3, made(60)[3][1], "aa", None, 1)]
    got = L.identify_languages(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = {(r.doc_id, r.lang_pred) for r in got.collect()}
    assert {(100, "und"), (101, "und"), (102, "und"), (103, "aa"), (None, "bb")} <= found
    assert got.count() == len(rows)
    assert got.where("lang_pred = 'und' and score <> 0 or score < 0 or score > 1").count() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.where("doc_id is not null").collect())
    kept = L.keep_languages(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert not {100, 101, 102} & {r.doc_id for r in kept.collect()}
    assert kept.count() >= 60
    empty = spark.createDataFrame([], SCHEMA)
    assert L.identify_languages(empty).count() == 0 and L.keep_languages(empty).count() == 0
    unlabelled = L.identify_languages(spark.createDataFrame([(1, "some text", None, None, None)], SCHEMA)).collect()
    assert unlabelled[0].lang_pred == "und"


def test_label_and_source_are_no_input(spark):
    docs = spark.createDataFrame(made(90), SCHEMA)
    model = L.train(docs)
    first = L.predict(docs, model, ["doc_id"]).orderBy("doc_id").collect()
    other = L.predict(docs.withColumn("lang", L.F.lit("zz")), model, ["doc_id"]).orderBy("doc_id").collect()
    assert first == other


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = got.where("lang = lang_pred").count() / got.count()
    assert right > 0.97


def test_sample_has_its_size_whatever_repeats(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "fit", lambda samples, *_: seen.append(samples))
    rows = [(None, f"{t} {k}", "aa", None, 1) for k, (_, t, *_) in enumerate(made(500))]  # null ids, all texts differ
    rows += [(6, "the same row", "bb", None, 1)] * 400 + [(0, "another row", "bb", None, 1)]
    L.train(spark.createDataFrame(rows, SCHEMA).repartition(7), per_language=60)
    sizes = {k: sum(1 for lang, _ in seen[-1] if lang == k) for k in ("aa", "bb")}
    assert sizes == {"aa": 60, "bb": 60}


def test_many_languages_share_the_sample(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLES", 400)
    monkeypatch.setattr(L, "MARKS", 400)
    names = [chr(0x4E00 + k) for k in range(100)]
    rows = [(i, f"{n * 3} {n}{names[i % 7]}", n, None, 1) for i, n in enumerate(names * 8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = L.train(docs)
    assert model.languages == sorted(names) and model.weights.shape[1] == 100
    got = L.predict(docs, model, ["lang"]).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.9


def test_query_against_plain_prediction(spark):
    """Kernel values with every landmark, one by one, times coefficients solved without Nyström."""
    docs = made(48) + [(1000 + i, t, None, None, None) for i, (_, t, *_) in enumerate(made(24, seed=9))]
    got = {r.doc_id: r for r in L.identify_languages(spark.createDataFrame(docs, SCHEMA), ridge=1e-9).collect()}
    learned = [(t, k) for i, t, k, *_ in docs if k and zlib.crc32(str(i).encode()) % 4 != 2]
    names = sorted({k for _, k in learned})
    kernel = np.array([[plain_kernel(a, b) for b, _ in learned] for a, _ in learned])
    target = np.array([[k == n for n in names] for _, k in learned], float)
    weights = np.linalg.lstsq(kernel, target, rcond=1e-8)[0]
    for i, t, *_ in docs:
        values = np.array([plain_kernel(t, b) for b, _ in learned]) @ weights
        assert got[i].lang_pred == names[values.argmax()]
        assert abs(got[i].score - min(1.0, max(0.0, values.max()))) < 1e-3
