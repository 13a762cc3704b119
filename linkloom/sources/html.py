"""Pages of HTML: text blocks, links and the sentence that each link stands in. There is no HTML parser among Spark's
functions, so pages are parsed in Arrow batches with the standard library's."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of blocks that are no text of the page, and words of headings that end it.
JUNK_CLASSES = ("reflist", "navbox", "sistersitebox", "mw-references-wrap", "reference")
END_HEADINGS = ("references", "sources", "external links", "further reading", "notes")
#: Elements without an end tag; those whose text is not shown, and those that are not the page's own.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN, _AROUND = {"script", "style"}, {"nav", "footer"}
_BLOCKS = {"p", "li", "td", "h1", "h2", "h3"}
#: Bytes of a batch for Python if it holds more than a row, a session setting; pages of it that are parsed at a time.
ARROW_BYTES, PAGES_AT_ONCE = 8 << 20, 64
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


class _Block:
    def __init__(self, tag: str):
        self.tag, self.text, self.links = tag, [], []  # links: [target, [anchor text]]

    def shown(self) -> str:
        return "".join(self.text)


class Page(HTMLParser):
    """Blocks of a page in order. An open block ends where the next of its kind begins, as pages leave end tags out."""

    def __init__(self, html: str, prefix: str, clean: bool):
        super().__init__()
        self.prefix, self.clean, self.blocks, self.open, self.anchor = prefix, clean, [], [], None
        self.stack: list[str] = []
        self.hidden: list[int] = []  # depths of elements that are not shown
        self.cut: list[int] = []  # depths of elements whose rest is cut off
        self.feed(html or "")
        self.close()

    def _skipped(self) -> bool:
        return bool(self.hidden or self.cut)

    def _end_heading(self, block: _Block, depth: int) -> None:
        if self.clean and block.tag in ("h2", "h3") and any(w in block.shown().lower() for w in END_HEADINGS):
            self.blocks.remove(block)
            self.cut.append(depth)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        if tag in ("p", "li", "td") and self.stack and self.stack[-1] == tag:
            self.handle_endtag(tag)
        at = dict(attrs)
        self.stack.append(tag)
        classes = (at.get("class") or "").split()
        if tag in _HIDDEN or self.clean and (tag in _AROUND or tag in ("div", "span") and any(c in JUNK_CLASSES for c in classes)):
            self.hidden.append(len(self.stack))
        if self._skipped():
            return
        if tag in _BLOCKS:
            block = _Block(tag)
            self.blocks.append(block)
            self.open.append((len(self.stack), block))
        if tag == "a":
            href = at.get("href") or ""
            if href.startswith(self.prefix) and ":" not in href:
                self.anchor = [unquote(href.removeprefix(self.prefix).replace("_", " ")), []]
                for _, block in self.open:
                    block.links.append(self.anchor)

    def handle_data(self, data: str) -> None:
        if self._skipped():
            return
        for _, block in self.open:
            block.text.append(data)
        if self.anchor:
            self.anchor[1].append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack:
            depth, top = len(self.stack), self.stack.pop()
            while self.open and self.open[-1][0] >= depth:
                self._end_heading(self.open.pop()[1], depth - 1)
            self.hidden = [h for h in self.hidden if h < depth]
            self.cut = [c for c in self.cut if c < depth]
            if top == tag:
                break
        if tag == "a":
            self.anchor = None

    def of(self, *tags: str) -> list[_Block]:
        return [b for b in self.blocks if b.tag in tags and b.shown().strip()]


def _one_line(text: str) -> str:
    return " ".join(text.split())


def contexts(page: Page, low: int, high: int) -> dict[str, str]:
    """Of each target the first sentence of a paragraph or item that holds its anchor, if that has between low and high
    characters; a later link to the target takes the place of an earlier one."""
    out = {}
    for block in page.of("p", "li"):
        sentences = _SENTENCE.split(block.shown())
        for target, anchor in block.links:
            for s in sentences:
                line = _one_line(s)
                if "".join(anchor) in s and low < len(line) < high:
                    out[target] = line
                    break
    return out


def full_contexts(page: Page, least_words: int, low: int, high: int) -> dict[str, str]:
    """Of each target of a paragraph's link a sentence of enough words: one that holds its anchor, else one of the
    paragraphs that holds its title, else one of the items and cells that does."""
    enough = lambda s: len(s.split()) >= least_words
    split = lambda blocks: [s.strip() for b in blocks for s in _SENTENCE.split(_one_line(b.shown())) if enough(s)]
    body, other, found, targets = split(page.of("p")), split(page.of("li", "td")), {}, {}
    for block in page.of("p"):
        sentences = [s for s in _SENTENCE.split(_one_line(block.shown())) if enough(s)]
        for target, anchor in block.links:
            targets[target] = None
            words = "".join(anchor).strip()
            hit = next((s for s in sentences if words and words in s), None)
            if hit is not None:
                found[target] = hit
    for target in targets:
        if target not in found:
            hit = next((s for s in (*body, *other) if target in s), None)
            if hit is not None:
                found[target] = hit
    return {t: _one_line(s) for t, s in found.items() if low < len(_one_line(s)) < high}


def _rows(pages: DataFrame, schema: str, rows_of: Callable[[str], list[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), PAGES_AT_ONCE):
                part = b.slice(lo, PAGES_AT_ONCE)
                rows = [(i, *x) for i, h in zip(part.column("page_id").to_pylist(), part.column("html").to_pylist(), strict=True) for x in rows_of(h)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, schema)


def html_links(pages: DataFrame, prefix: str = "/") -> DataFrame:
    """(page_id, pos, target, anchor) of links within the site, in order; a block within a block counts once."""

    def rows_of(html: str) -> list[tuple]:
        seen, out = set(), []
        for block in Page(html, prefix, False).blocks:
            for link in block.links:
                if id(link) not in seen:
                    seen.add(id(link))
                    out.append((len(out), link[0], "".join(link[1]).strip()))
        return out

    return _rows(pages, "page_id long, pos long, target string, anchor string", rows_of)


def html_contexts(pages: DataFrame, prefix: str = "/", low: int = 10, high: int = 500) -> DataFrame:
    """(page_id, target, context), by the rule of `contexts`."""
    return _rows(pages, "page_id long, target string, context string", lambda html: list(contexts(Page(html, prefix, False), low, high).items()))


def html_full_contexts(pages: DataFrame, prefix: str = "/", least_words: int = 10, low: int = 10, high: int = 600) -> DataFrame:
    """(page_id, target, context), without junk blocks and end sections, by the rule of `full_contexts`."""
    return _rows(pages, "page_id long, target string, context string", lambda html: list(full_contexts(Page(html, prefix, True), least_words, low, high).items()))


def html_text(pages: DataFrame) -> DataFrame:
    """(page_id, text): a line for each heading, paragraph and item, without junk blocks and end sections."""
    return _rows(pages, "page_id long, text string", lambda html: [("\n".join(_one_line(b.shown()) for b in Page(html, "/", True).of("h1", "p", "li")),)])
