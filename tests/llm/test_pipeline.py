from collections import Counter

from test_line_dedup import plain as plain_lines
from test_near_copies import plain_groups

import corpus_pipeline
from talkweave.llm.language_id import MIN_SCORE, identify_languages
from talkweave.llm.line_dedup import MIN_PAGES, RATIO
from talkweave.llm.mixing import mix_sources
from talkweave.llm.sentence_piece import decode_documents


def test_stages_against_plain_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outs, columns = [docs], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, outs[-1], sf).write.parquet(str(tmp_path / f"{k}-{name}"))
        outs.append(spark.read.parquet(str(tmp_path / f"{k}-{name}")))
    assert all(o.columns == columns for o in outs[:-1])
    given, known, clean, single, mixed, tokens = [o.collect() for o in outs]

    judged = {r.doc_id: r for r in identify_languages(docs).collect()}
    fine = {i for i, r in judged.items() if r.lang_pred != "und" and r.score >= MIN_SCORE}
    assert sorted(known) == sorted(r for r in given if r.doc_id in fine)

    want = plain_lines([(r.doc_id, r.text, r.source) for r in known], RATIO, MIN_PAGES)
    want = {i: (t, len(t or "")) for i, t, _, _, lost in want if not lost or (t or "").strip(" ")}
    assert {r.doc_id: (r.text, r.n_chars) for r in clean} == want and len(clean) == len(want)

    rows = sorted(clean, key=lambda r: r.doc_id)
    roots = plain_groups([r.text for r in rows])
    assert sorted(r.doc_id for r in single) == sorted(rows[i].doc_id for i in set(roots))

    plan = mix_sources(outs[3]).collect()
    assert Counter(r.doc_id for r in mixed) == Counter({r.doc_id: r.copies for r in plan if r.copies})
    aims = {(r.source_size, r.target) for r in plan}
    total = sum(len((r.text or "").split()) for r in single)
    assert abs(sum(t for _, t in aims) - 1.5 * total) < 1
    texts = {r.doc_id: r.text for r in single}
    assert all(r.text == texts[r.doc_id] for r in mixed)

    spelled = decode_documents(outs[5]).collect()
    assert Counter((r.doc_id, r.text) for r in spelled) == Counter((r.doc_id, r.text) for r in mixed)
    assert len(tokens) == len(mixed)


def test_run_is_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "tokens"] and out.count() > 0


def test_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
