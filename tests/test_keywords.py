"""Keyword counts by one automaton against str.count, and topics against a plain scoring."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.functions import keywords, topics


def test_counts(monkeypatch):
    monkeypatch.setattr(keywords, "SLICE", 40)
    draw = random.Random(4)
    words = ("aa", "a", "aba", "b", "abab", "é", "x y", "existence")
    texts = ["".join(draw.choice("ab é") for _ in range(draw.randrange(30))) for _ in range(300)] + [None, "", "existencexistence existence", "a\x00a", "x yx y"]
    row, word, n = keywords.counts(pa.array(texts), words)
    got = {(r, w): c for r, w, c in zip(row.tolist(), word.tolist(), n.tolist())}
    want = {(i, k): t.count(w) for i, t in enumerate(texts) if t for k, w in enumerate(words) if t.count(w)}
    assert got == want
    assert [len(x) for x in keywords.counts(pa.array([], pa.string()), words)] == [0, 0, 0]
    with pytest.raises(ValueError, match="twice"):
        keywords.counts(pa.array(["a"]), ("a", "a"))


@pytest.mark.parametrize("scheme", [topics.FULL, topics.SHORT])
def test_topics(spark, scheme):
    draw = random.Random(9)
    words = [w for _, ws in scheme for w in ws] + ["nothing", "and", "the"] * 20
    rows = [(i, " ".join(draw.choice(words) for _ in range(2)).title(), [draw.choice(words) for _ in range(draw.randrange(6))]) for i in range(200)] + [(900, None, None), (901, "", [])]

    def plain(title, cats):
        t = (title or "").lower()
        a = t + " " + " ".join(cats or []).lower()
        scores = [sum(a.count(w) + (5 if w in t else 0) for w in ws if w in a) for _, ws in scheme]
        return scores.index(max(scores)) if max(scores) else len(scheme)

    df = spark.createDataFrame(rows, "id long, title string, cats array<string>")
    got = {r.id: r.t for r in df.select("id", topics.topic_id(F.col("title"), F.col("cats"), scheme).alias("t")).collect()}
    assert got == {i: plain(t, c) for i, t, c in rows}
