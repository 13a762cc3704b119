"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may stand in a document with up to k = floor(rate * m) edits. Split into k + 1 pieces, at
least one piece stands there unchanged, so an automaton over all pieces finds every place that needs a look. The same
holds for any division of the pieces in two: one part of p pieces stands there with at most p - 1 edits. So a place is
looked at in ever larger parts around the piece, from two pieces up to the item, and left at the first that does not
fit. Myers' bit-parallel algorithm gives the edit distance of a part to the best substring of the place. Texts are
compared in lower case with runs of white space as one space."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded

#: Edits allowed for a character of an item.
ERROR_RATE = 0.1
#: Items go to the workers in blocks of at most so many bytes of text; an automaton takes about 200 times as much memory.
BLOCK_BYTES = 1 << 20
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
FOUND = "doc_id long, item_id long, distance int, start int, end int"


def plain(text: str | None) -> str:
    return _SPACE.sub(" ", (text or "").lower()).strip()


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about equal length, with their offsets; an item shorter than that has one a character."""
    n = min(k + 1, len(text))
    cut = [i * len(text) // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Pattern:
    """An item as bit masks."""

    def __init__(self, text: str):
        self.m = len(text)
        self.full, self.top = (1 << self.m) - 1, 1 << self.m - 1
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, k: int) -> tuple[int, int] | None:
        """(distance, end) of the substring nearest to the item, if within k; the first of the nearest."""
        up, down, score, found = self.full, 0, self.m, None
        full, top, masks = self.full, self.top, self.masks
        for j, c in enumerate(text):
            same = masks.get(c, 0)
            vertical = same | down
            level = (((same & up) + up) ^ up) | same
            plus = down | full & ~(level | up)
            minus = up & level
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            if score <= k and (found is None or score < found[0]):
                found = (score, j + 1)
                if not score:
                    return found
            plus = plus << 1 & full
            up = (minus << 1 & full) | full & ~(vertical | plus)
            down = plus & vertical
        return found


def parts_around(text: str, split: list[tuple[int, str]]) -> list[list[tuple[int, int, Pattern]]]:
    """For each piece, the parts that hold it, from the smallest: (characters before the piece, edits allowed, part)."""
    out: list[list[tuple[int, int, Pattern]]] = [[] for _ in split]

    def divide(lo: int, hi: int, whole: bool) -> None:
        if hi - lo > 1:
            mid = (lo + hi) // 2
            divide(lo, mid, False)
            divide(mid, hi, False)
            if not whole:
                a, b = split[lo][0], split[hi - 1][0] + len(split[hi - 1][1])
                part = Pattern(text[a:b])
                for i in range(lo, hi):
                    out[i].append((split[i][0] - a, hi - lo - 1, part))

    divide(0, len(split), True)
    return out


def stands(text: str, begin: int, around: list[tuple[int, int, Pattern]]) -> bool:
    """Whether every part around a piece that begins there fits."""
    for before, k, part in around:
        a = begin - before
        if part.best(text[max(0, a - k) : a + part.m + k], k) is None:
            return False
    return True


class Matcher:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, places = [], {}
        for item_id, text in items:
            text = plain(text)
            if not text:
                continue
            k = budget(len(text), rate)
            split = pieces(text, k)
            for (at, piece), around in zip(split, parts_around(text, split), strict=True):
                places.setdefault(piece, []).append((len(self.items), at, around))
            self.items.append((item_id, text, k, Pattern(text), Pattern(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item's best place, the first of the best."""
        if not self.items or not text:
            return []
        seen: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            begin = end - length + 1
            for item, at, around in where:
                if begin - at not in seen.get(item, ()) and stands(text, begin, around):
                    seen.setdefault(item, set()).add(begin - at)
        out = []
        for item, diagonals in seen.items():
            item_id, body, k, forward, back = self.items[item]
            best, lo, hi = None, None, None

            def look(lo: int, hi: int, best):
                lo = max(lo, 0)
                got = forward.best(text[lo:hi], k)
                return (got[0], lo + got[1]) if got and (best is None or got[0] < best[0]) else best

            for d in sorted(diagonals):  # windows that overlap are looked at as one
                a, b = d - k, d + len(body) + k
                if hi is not None and a <= hi:
                    hi = b
                    continue
                if hi is not None:
                    best = look(lo, hi, best)
                lo, hi = a, b
            best = look(lo, hi, best)
            if best:
                distance, end = best
                _, n = back.best(text[max(0, end - len(body) - k) : end][::-1], distance) or (0, len(body))
                out.append((item_id, distance, end - n, end))
        return out


_matchers: dict[str, Matcher] = {}


def match_scan(items, key: str, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(items.value, rate)
        m = _matchers[key]
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                rows += [(doc_id, *x) for x in m.find(plain(text.as_py()))]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "item_id", "distance", "start", "end"])

    return run


def blocks_of(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, streamed partition by partition."""
    block, size = [], 0
    for r in items.toLocalIterator():
        n = len((r.text or "").encode())
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """docs: (doc_id, text); items: (item_id, text). Returns a row for each row of docs and item that stands in it:
    doc_id, item_id, distance, start, end (code points of the compared text; the best place, the first of the best).

    Null and empty texts and items match nothing. An item shorter than 1 / rate must stand unchanged. Repeated rows and
    items each match. No items: no rows. Items are broadcast in blocks of BLOCK_BYTES; each block is one pass over the
    documents. Nothing is shuffled; a very common passage costs its verification in each document. An item longer
    than 60,000 characters is still exact, at a cost that grows with the square of its length."""
    spark = docs.sparkSession
    texts = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks_of(items.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        part = texts.mapInArrow(match_scan(spark.sparkContext.broadcast(block), uuid.uuid4().hex, rate), FOUND)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], FOUND) if out is None else out


def keep_scan(items, key: str, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(items.value, rate)
        m = _matchers[key]
        for b in batches:
            yield b.filter(pa.array([not m.find(plain(t.as_py())) for t in b.column("text")], pa.bool_()))

    return run


def remove_leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; one pass a block of items, and no shuffle."""
    for block in blocks_of(items.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        docs = bounded(docs).mapInArrow(keep_scan(docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex, rate), docs.schema)
    return docs
