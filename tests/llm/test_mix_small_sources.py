"""Sources of few documents: taken words come as near their targets as whole documents allow."""

import pytest

from linkloom.llm import mixing


def test_one_document_near_its_target(spark):
    # weights 5, 2, 1: source a has one long document, its target lies a little under it
    rows = [(0, "w " * 1000, "a", 7)] + [(k, "w " * 10, "b", 7) for k in range(1, 40)] + [(100 + k, "w " * 8, "c", 7) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    by = {}
    for r in mixing.mix_sources(df, weights=(5, 2, 1)).collect():
        t = by.setdefault((r.source_size, r.target), [0, 0])
        t[0] += r.taken
        t[1] = max(t[1], r.size)
    for (_, target), (taken, largest) in by.items():
        assert abs(taken - target) <= largest / 2
    with pytest.raises(ValueError, match="size"):
        mixing.mix_sources(df, keep=("size",))
    kept = mixing.mix_sources(df, keep=("source",)).where("doc_id = 0").first()
    assert kept.source == "a" and kept.taken in (1000, 2000)


def test_repeated_rows_go_together(spark):
    df = spark.createDataFrame([(1, "w " * 50, None)] * 3 + [(2, "w " * 300, "b")], "doc_id long, text string, source string")
    rows = mixing.mix_sources(df).collect()
    assert len({(r.doc_id, r.copies) for r in rows}) == 2 and len(rows) == 4
