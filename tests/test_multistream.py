"""The reader of multistream dumps: any split gives every page once."""

import bz2
import random

import pytest

from linkloom.sources import articles, multistream

PAGE = "<page><title>{}</title><ns>{}</ns><revision><text>{}</text></revision></page>"


def pages(n, seed=1):
    draw = random.Random(seed)
    return [(f"T{k} é&amp;", draw.choice("0001"), f"text {k} ü " + "x" * draw.randrange(2000) + draw.choice(["", "#REDIRECT"])) for k in range(n)]


def write(path, parts):
    offsets, at = [], 0
    with open(path, "wb") as f:
        for p in parts:
            offsets.append(at)
            at += f.write(bz2.compress(p, 1))
    return offsets, at


@pytest.mark.parametrize("how", ["whole", "cut"])
def test_every_page_once(spark, tmp_path, how):
    rows = pages(60)
    body = ("<mediawiki>" + "\n".join(PAGE.format(*r) for r in rows) + "</mediawiki>").encode()
    if how == "whole":
        parts = [b"<mediawiki>", *["\n".join(PAGE.format(*r) for r in rows[k : k + 7]).encode() for k in range(0, 60, 7)], b"</mediawiki>"]
    else:  # streams that end anywhere: within pages, tags and characters; some hold no page begin, one is empty
        draw = random.Random(3)
        tag = body.index(b"<page>", 5000) + 3
        at = sorted({0, len(body), tag, body.index("é".encode(), 9000) + 1, *[draw.randrange(len(body)) for _ in range(25)], *range(20000, 20060, 20)})
        parts = [body[a:b] for a, b in zip(at, at[1:])]
        parts.insert(4, b"")
    _, size = write(tmp_path / "d.bz2", parts)
    want = sorted((t.replace("&amp;", "&"), ns, x) for t, ns, x in rows)
    for split in (size + 1, size // 3, 997, 131):
        df = multistream.read_pages(spark, str(tmp_path / "d.bz2"), split)
        assert sorted(tuple(r) for r in df.collect()) == want, split
        assert df.rdd.getNumPartitions() == -(-size // split)


def test_rows_of_read_dump(spark, tmp_path):
    rows = [(f"A{k}", "0" if k % 4 else "1", "" if k % 9 == 0 else "#redirect [[x]]" if k % 7 == 0 else f"Text {k} [[b|c]] & <ref>") for k in range(50)]
    path = str(tmp_path / "d.xml.bz2")
    index = multistream.write_dump(rows, path, 6)
    want = sorted(tuple(r) for r in articles.read_dump(spark, path).collect())
    assert want and sorted(tuple(r) for r in multistream.read_dump(spark, path, 200).collect()) == want
    (tmp_path / "i.txt").write_text("".join(f"{o}:{i}:{t}\n" for o, i, t in index))
    idx = multistream.read_index(spark, str(tmp_path / "i.txt"))
    got = {r.title: (r.offset, r.end) for r in idx.collect()}
    starts = sorted({o for o, _, _ in index})
    assert got == {t: (o, next((s for s in starts if s > o), None)) for o, _, t in index}
    some = multistream.read_streams(idx.where("title = 'A13'"), path).collect()
    assert sorted(r.title for r in some) == sorted(t for o, _, t in index if o == got["A13"][0])


def test_errors(spark, tmp_path, monkeypatch):
    write(tmp_path / "none.bz2", [b"no pages here"])
    assert multistream.read_pages(spark, str(tmp_path / "none.bz2")).count() == 0
    (tmp_path / "empty.bz2").write_bytes(b"")
    assert multistream.read_pages(spark, str(tmp_path / "empty.bz2")).count() == 0
    raw = bz2.compress(PAGE.format("a", 0, "b" * 5000).encode())
    (tmp_path / "cut.bz2").write_bytes(raw[:-6])
    with pytest.raises(Exception, match="ends within a stream"):
        multistream.read_pages(spark, str(tmp_path / "cut.bz2")).count()
    f, _ = multistream.open_input(str(tmp_path / "cut.bz2"))
    monkeypatch.setattr(multistream, "MOST_PAGE", 100)
    write(tmp_path / "long.bz2", [b"<page>" + b"x" * 300])
    f, size = multistream.open_input(str(tmp_path / "long.bz2"))
    with pytest.raises(ValueError, match="more than 100 bytes"):
        list(multistream.pages_between(f, 0, size))
