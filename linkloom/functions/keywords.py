"""Many keywords counted in one pass over a column of texts.

A batch's texts are one string, a character that no keyword holds between them; an automaton of all keywords runs over it
once, and its hits, as arrays of places and keywords, are told apart by text and counted in numpy. The work grows with the
texts and the hits, not with the number of keywords."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stands between texts; taken out of texts beforehand.
_APART = "\x00"
#: Characters of texts that the automaton takes at a time, about.
SLICE = 4 << 20


@lru_cache(maxsize=16)
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, w in enumerate(words):
        if not w or _APART in w:
            raise ValueError(f"no keyword: {w!r}")
        out.add_word(w, k)
    out.make_automaton()
    return out


def _overlaps(word: str) -> bool:
    """Whether a word can overlap itself."""
    return any(word.startswith(word[k:]) for k in range(1, len(word)))


def _apart(row: np.ndarray, word: np.ndarray, at: np.ndarray, words: tuple[str, ...]) -> np.ndarray:
    """Which hits count: of hits of one word that overlap in a text the first, then the next that does not overlap it."""
    keep = np.ones(len(at), bool)
    for k, w in enumerate(words):
        if _overlaps(w):
            mine = np.flatnonzero(word == k)
            end, of = -1, -1
            for i in mine.tolist():  # only words like "existence", and only where they stand
                if row[i] == of and at[i] < end + len(w):
                    keep[i] = False
                else:
                    of, end = row[i], at[i]
    return keep


def counts(column: pa.Array, words: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, n): how often each word stands in each text without overlapping itself, where it does; by row and
    word. Words are told apart by their place; nulls hold none."""
    if len(set(words)) != len(words):
        raise ValueError("a keyword is given twice")
    auto, found = _automaton(words), []
    texts = pc.replace_substring(column.fill_null(""), _APART, " ")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    lo = 0
    ends = np.cumsum(sizes)
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        hits = np.array(list(auto.iter(_APART.join(texts.slice(lo, hi - lo).to_pylist()))), np.int64).reshape(-1, 2)
        starts = np.concatenate(([0], np.cumsum(sizes[lo : hi - 1] + 1)))
        row = np.searchsorted(starts, hits[:, 0], "right") - 1
        ok = _apart(row, hits[:, 1], hits[:, 0], words)
        found.append(((row[ok] + lo) * len(words) + hits[ok, 1]))
        lo = hi
    key, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return key // len(words), key % len(words), n


def best_topics(title: pa.Array, joined: pa.Array, scheme: tuple[tuple[str, tuple[str, ...]], ...]) -> pa.Array:
    """Of each text (joined) the place of the topic of the highest score, the first of equal ones; the number of topics
    where all are 0. A keyword counts once for each time it stands in the text, five times more if it stands in the
    title; a keyword of two topics counts for both."""
    words = tuple(sorted({w for _, ws in scheme for w in ws}))
    times = np.array([[ws.count(w) for _, ws in scheme] for w in words], np.int64)
    score = np.zeros((len(joined), len(scheme)), np.int64)
    row, word, n = counts(joined, words)
    np.add.at(score, row, n[:, None] * times[word])
    t_row, t_word, _ = counts(title, words)
    there = np.isin(t_row * len(words) + t_word, row * len(words) + word)
    np.add.at(score, t_row[there], 5 * times[t_word[there]])
    return pa.array(np.where(score.max(axis=1, initial=0) > 0, score.argmax(axis=1) if len(score) else 0, len(scheme)).astype(np.int32))
