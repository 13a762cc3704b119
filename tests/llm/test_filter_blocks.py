"""A filter broadcast in blocks gives the scores of one that is broadcast whole."""

import random

from linkloom.llm import language_model

from .test_text_operators import ODD, frame


def test_blocks_score_like_the_whole_filter(spark, monkeypatch):
    docs = [(i, " ".join(f"w{int(random.Random(i * 1000 + k).paretovariate(0.4)) % 3000}" for k in range(i % 90))) for i in range(10, 400)] + ODD
    df, key = frame(spark, docs), "crc32(cast(doc_id as string)) % 5 <> 1"
    by = lambda out: sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in out)
    whole = by(language_model.score_language_model(df, key).collect())
    monkeypatch.setattr(language_model, "LEAST_BLOCK", 8_000)
    count, real = [], language_model.level_scan
    monkeypatch.setattr(language_model, "level_scan", lambda shared: count.append(1) or real(shared))
    parted = by(language_model.score_language_model(df, key, broadcast_bytes=0).collect())
    assert len(count) >= 3
    assert [a[:4] for a in whole] == [b[:4] for b in parted] and all(abs(a[4] - b[4]) <= 1e-9 * abs(a[4]) for a, b in zip(whole, parted, strict=True))
    assert language_model.score_language_model(frame(spark, []), key, broadcast_bytes=0).collect() == []
