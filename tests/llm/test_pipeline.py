"""The corpus pipeline against the plain versions of its stages."""

import brute
from test_llm_operators import corpus, frame, library


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C
    docs = corpus(seed=8, n=70)
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.source or "", tuple(r.ids)) for r in C.run(spark, str(tmp_path)).collect())
    kept = []
    for (i, t, s), q in zip(docs, brute.quality(docs)):
        if q[6]:
            kept.append((i, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in q[8]), s))
    kept = [(i, x[0], s) for (i, _, s), x in zip(kept, brute.line_dedup(kept)) if brute.WORD.search(x[0])]
    one = []
    for (i, t, s), (_, c) in zip(kept, brute.near(kept)):
        if i == c or c is None:
            if (i, t, s) not in one:
                one.append((i, t, s))
    lib, want = library(), []
    for (i, t, s), (n, _, _, taken) in zip(one, brute.mix(one)):
        for _ in range(taken // n if n else 0):
            want.append((i is None, i or 0, s or "", tuple(lib.encode(t))))
    blank = [g for g in got if not g[3]]
    assert [g for g in got if g not in blank] == sorted(w for w in want if w[3])
    assert {s for s, _ in C.STAGES} == {"quality_rules", "line_dedup", "near_dedup", "mixing", "sentencepiece"}


def test_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline as C
    docs = frame(spark, corpus(seed=8, n=40))
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
