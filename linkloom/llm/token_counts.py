"""Token counts by a compiled finite-state transducer.

A sentencepiece BPE model is compiled into a deterministic transducer over characters. Reading a text's prefix, the
machine knows how many tokens the model gives for it: a tokenization is the model's exactly if every two neighbouring
tokens are the model's own tokenization of their concatenation, so the last token of a prefix is the one that ends
there, is what the model makes of its own text, and is stable behind the last token of the prefix before it. What the
future can still see is therefore finite: for every position at which a longer token that is under way may have begun,
the last token before it and how many tokens fewer there were. That is a state; a transition to the next character's
state carries how many tokens more the new prefix has (a number below 0 where pieces merge). States are found as texts
need them and kept, with their transitions, in a hash table that numpy reads for many texts at once.

Between two characters that stand beside each other in no piece no merge can reach across: the machine is back in its
start state there. Texts are cut into chunks; a chunk's state map takes the state it is entered with to the state it is
left with and the tokens between. From a chunk's first reset place on the map is constant, and these parts are run for
all chunks in step. What stands before it, or a whole chunk without such a place, is mapped for the states that it may
be entered with: those that the map before it gives, and one that is guessed from the end of the text before it, so that
all chunks start at once; chunks of the same text share their map. The maps of a text's chunks are then composed by a
parallel prefix scan (pointers that double their reach each round), which gives the state that enters each chunk.
Token counts add up along the chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_column, bounded, mix64, powers, slices

#: Characters of a chunk, and those before it from which its first state is guessed.
CHUNK, GUESS = 256, 64
#: Bytes of text taken at a time.
BATCH_BYTES = 2 << 20
#: States after which a worker's table is started anew, so that its memory stays bounded.
MOST_STATES = 250_000
_SPACE = "▁"


class Transducer:
    """The compiled machine of a model; one a worker, growing as texts need it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score, self.single = {}, {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        self.piece = {p: p for p in self.score}  # one object for all states that hold a piece
        self.prefixes = {p[:k] for p in self.score for k in range(1, len(p))}
        chars = sorted({c for p in self.score for c in p})
        if missing := [c for c in chars if c not in self.score]:
            raise ValueError(f"a model in which each character of a piece is a piece is needed; {missing[:5]} are none")
        self.bits = (len(chars) + 1).bit_length()
        #: The class of a character: from 1, in pieces; 0, in none (one token a UTF-8 byte).
        self.cls = np.zeros(0x110000, np.int32)
        self.cls[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.chars = ["", *chars]
        n = len(self.chars)
        beside = np.zeros((n, n), bool)
        for p in self.score:
            for a, b in zip(p, p[1:], strict=False):
                beside[self.cls[ord(a)], self.cls[ord(b)]] = True
        self.hard = ~beside
        self.stable: dict[tuple[str, str], bool] = {}
        self.own: dict[str, bool] = {}
        self.clear()

    def clear(self) -> None:
        # state 0 is the start, before any character
        self.states: list[tuple] = [((), "")]
        self.number = {self.states[0]: 0}
        self._grow(1 << 16)

    def _grow(self, size: int) -> None:
        old = getattr(self, "keys", None)
        keep = None if old is None or len(self.states) == 1 else (old[old >= 0], self.to[old >= 0], self.delta[old >= 0])
        self.keys, self.to, self.delta = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)
        self.filled = 0
        if keep:
            for k, t, d in zip(*map(np.ndarray.tolist, keep), strict=True):
                self._put(k, t, d)

    def _slot(self, key):
        return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 20 & len(self.keys) - 1

    def _put(self, key: int, to: int, delta: int) -> None:
        at, mask = self._slot(key), len(self.keys) - 1
        while self.keys[at] != -1:
            at = (at + 1) & mask
        self.keys[at], self.to[at], self.delta[at] = key, to, delta
        self.filled += 1
        if 2 * self.filled > len(self.keys):
            self._grow(4 * len(self.keys))

    # ------------------------------------------------------------------------------------ compilation

    def tokenize(self, text: str) -> list[str]:
        """What the model makes of a short text of known characters: the best-scored neighbours merge, leftmost first."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def behind(self, last: str, piece: str) -> bool:
        """Whether piece is a token, and one that stands behind last."""
        if piece not in self.own:
            self.own[piece] = piece in self.score and self.tokenize(piece) == [piece]
        if not self.own[piece] or not last:
            return self.own[piece]
        key = (last, piece)
        if key not in self.stable:
            if len(self.stable) > 300_000:
                self.stable.clear()
            self.stable[last, self.piece[piece]] = self.tokenize(last + piece) == [last, piece]
        return self.stable[key]

    def step(self, state: int, c: int) -> tuple[int, int]:
        """(next state, tokens more) of a character; from state 0 as after a hard place.

        A state is (begins, suffix): the text of the longest token under way, and for each position where one may have
        begun (its distance back) the last token before it and how many tokens there were fewer."""
        begins, suffix = self.states[state]
        suffix += self.chars[c]
        found = None
        for back, last, fewer in (*begins, *(() if begins else ((0, "", 0),))):
            piece = suffix[len(suffix) - back - 1 :]
            if self.behind(last, piece):
                found = (self.piece[piece], fewer)
        piece, fewer = found
        delta = 1 - fewer
        new = [(back + 1, last, few + delta) for back, last, few in (begins or ((0, "", 0),)) if suffix[len(suffix) - back - 1 :] in self.prefixes]
        new.append((0, piece, 0))
        longest = max(b for b, _, _ in new)
        key = (tuple(new), suffix[len(suffix) - longest :] if longest else "")
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key], delta

    # ------------------------------------------------------------------------------------ running

    def advance(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and tokens more for many machines at once."""
        key = state.astype(np.int64) << self.bits | c
        while True:
            mask = np.uint64(len(self.keys) - 1)
            at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) & mask).astype(np.int64)
            got = self.keys[at]
            off = np.flatnonzero((got != key) & (got != -1))
            while len(off):
                at[off] = (at[off] + 1) & int(mask)
                got[off] = self.keys[at[off]]
                off = off[(got[off] != key[off]) & (got[off] != -1)]
            missing = np.flatnonzero(got == -1)
            if not len(missing):
                return self.to[at], self.delta[at]
            for k in np.unique(key[missing]).tolist():
                self._put(k, *self.step(k >> self.bits, k & (1 << self.bits) - 1))

    def run(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, hard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Machines over text[start:end] in step, entered with a state; (state, tokens) of each at its end."""
        state, tokens = state.astype(np.int32), np.zeros(len(start), np.int64)
        order = np.argsort(start - end, kind="stable")
        start, length = start[order], (end - start)[order]
        s, t = state[order], tokens[order]
        live = len(order)
        for k in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -k, "left"))
            at = start[:live] + k
            s[:live][hard[at]] = 0
            s[:live], more = self.advance(s[:live], text[at])
            t[:live] += more
        state[order], tokens[order] = s, t
        return state, tokens

    def scan(self, text: np.ndarray, lo: np.ndarray, hi: np.ndarray, entered: np.ndarray, entry: np.ndarray, hard: np.ndarray) -> np.ndarray:
        """Tokens of parts without a reset place. A part is entered with a known state, or else in the state that the
        part just before it is left with."""
        n = len(lo)
        length = hi - lo
        at = np.repeat(lo - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        sums = np.add.reduceat(mix64(text[at].astype(np.uint64)) * powers(int(length.max()))[at - np.repeat(lo, length)], np.cumsum(length) - length)
        _, one, same = np.unique(mix64(sums + length.astype(np.uint64)), return_index=True, return_inverse=True)
        later = np.flatnonzero(~entered)
        guess, _ = self.run(text, np.maximum(lo[later] - GUESS, lo[later - 1]), lo[later], np.zeros(len(later), np.int32), hard)
        # maps, as (part's text, state at its beginning) -> (state at its end, tokens), until they are closed
        pair = lambda q, s: q.astype(np.int64) << 32 | s
        follow = np.unique(pair(same[later - 1], same[later]))
        asked = np.unique(np.concatenate((pair(same[entered], entry[entered]), pair(same[later], guess))))
        keys, ends, costs = (np.zeros(0, np.int64) for _ in range(3))
        while len(asked):
            part = one[asked >> 32]
            s, t = self.run(text, lo[part], hi[part], asked & 0xFFFFFFFF, hard)
            keys, ends, costs = np.concatenate((keys, asked)), np.concatenate((ends, s)), np.concatenate((costs, t))
            order = np.argsort(keys)
            keys, ends, costs = keys[order], ends[order], costs[order]
            # of parts that stand beside each other: the states that the first may be left with enter the second
            known = np.searchsorted(asked, follow >> 32 << 32), np.searchsorted(asked, (follow >> 32) + 1 << 32)
            many = known[1] - known[0]
            which = np.repeat(known[0] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            new = np.unique(pair(np.repeat(follow & 0xFFFFFFFF, many), s[which]))
            asked = new[~np.isin(new, keys, assume_unique=True)]
        # a node for each part and state it may be entered with; a pointer to the node of the part behind it
        begin = np.searchsorted(keys, same.astype(np.int64) << 32)
        many = np.searchsorted(keys, same.astype(np.int64) + 1 << 32) - begin
        base = np.concatenate(([0], np.cumsum(many)))
        owner = np.repeat(np.arange(n), many)
        row = np.arange(base[-1]) - base[owner] + begin[owner]
        node = lambda k, s: base[k] + np.searchsorted(keys, pair(same[k], s)) - begin[k]
        behind = np.full(n, -1)
        behind[later - 1] = later
        to = np.full(base[-1] + 1, base[-1])
        goes = np.flatnonzero(behind[owner] >= 0)
        to[goes] = node(behind[owner[goes]], ends[row[goes]])
        reached = np.zeros(base[-1] + 1, bool)
        reached[node(np.flatnonzero(entered), entry[entered])] = True
        while (to < base[-1]).any():
            reached[to[reached]] = True
            to = to[to]
        hit = np.flatnonzero(reached[:-1])
        out = np.zeros(n, np.int64)
        out[owner[hit]] = costs[row[hit]]
        return out

    def count(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens of each text; chars: code points of all texts, first: where each begins, and the end. No text is
        empty, and each begins with the space that the model puts before a text."""
        if len(self.states) > MOST_STATES:
            self.clear()
        text = self.cls[chars]
        utf8 = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        plain = text > 0
        hard = np.ones(len(text), bool)
        hard[1:] = self.hard[text[:-1], text[1:]]
        hard[first[:-1]] = True
        other = np.where(plain, 0, utf8)
        lengths = np.diff(first)
        # chunks, none across texts
        per = -(-lengths // CHUNK)
        owner = np.repeat(np.arange(len(lengths)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        lo = first[owner] + nth * CHUNK
        hi = np.minimum(lo + CHUNK, first[owner + 1])
        # where each chunk's map becomes constant
        places = np.flatnonzero(hard)
        at = np.searchsorted(places, lo)
        split = np.where(at < len(places), places[np.minimum(at, len(places) - 1)], len(text))
        split = np.minimum(split, hi)
        constant = split < hi
        # characters in no piece are tokens of their own and stand between hard places: left out of the machine
        skip = np.concatenate(([0], np.cumsum(plain)))
        small, small_hard = text[plain], hard[plain]
        go = lambda a, b, s: self.run(small, skip[a], skip[b], s, small_hard)
        state, tokens = np.zeros(len(lo), np.int32), np.zeros(len(lo), np.int64)
        state[constant], tokens[constant] = go(split[constant], hi[constant], np.zeros(int(constant.sum()), np.int32))
        head = np.flatnonzero(split > lo)
        if len(head):
            before = np.where(nth[head] > 0, head - 1, -1)
            entered = (before < 0) | constant[before]  # the state at the head's beginning is known
            entry = np.where(before >= 0, state[before], 0)
            tokens[head] += self.scan(small, skip[lo[head]], skip[split[head]], entered, entry, small_hard)
        out = np.bincount(owner, tokens, minlength=len(lengths))
        return (out + np.add.reduceat(other, first[:-1])).astype(np.int64)


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def with_spaces(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, begins, rows) of the texts that are not empty, as the model reads them: a space put before each,
    and spaces as U+2581."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    leads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    begin = leads[offsets]
    rows = np.flatnonzero(np.diff(begin))
    n = np.diff(begin)[rows] + 1
    first = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(int(first[-1]), np.int64)
    own = np.ones(len(out), bool)
    own[first[:-1]] = False
    out[own] = np.where(points == 0x20, ord(_SPACE), points)
    out[~own] = ord(_SPACE)
    return out, first, rows


def count_scan(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for b in batches:
            offsets, data = binary_column(b.column("text"))
            for lo, hi in slices(offsets, most_bytes=BATCH_BYTES):
                own = offsets[lo : hi + 1] - offsets[lo]
                tokens = np.zeros(hi - lo, np.int64)
                chars, first, rows = with_spaces(own, data[offsets[lo] : offsets[hi]])
                if len(rows):
                    tokens[rows] = m.count(chars, first)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(own)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """docs: (doc_id, text); path: a sentencepiece BPE model with identity normalisation and byte fallback, at the same
    place on every worker. Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per row of docs.

    Counts are those of the library's encode() without begin, end or added special tokens; strings that look like
    special tokens are text. Null and empty texts have 0 bytes and tokens. Texts of any length are cut into chunks, and
    a batch takes a bounded number of bytes, or one text. Repeated rows get a row each; other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count_scan(path, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
