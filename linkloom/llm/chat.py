"""Chat formatting by columnar byte assembly.

A turn is `[INST]` role `[/INST]` text `</s>`. Control strings inside roles and texts get a backslash after their
opening bracket (one more where there are some already), which reading takes away again, so every text comes back as it
was. A batch of turns is assembled at once: the lengths of all segments give the offset of each, and headers and
contents are copied by index arrays into one preallocated buffer, which with the offsets of conversations is the Arrow
column. Texts of the assistant are under the loss mask, given in code points."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SLICE_BYTES, binary_column, bounded, slices

OPEN, CLOSE, END = b"[INST]", b"[/INST]", b"</s>"
TRAINED = b"assistant"
_CONTROL = r"([<\[])(\\*)(/?(?:INST|SYS|s)[>\]])"
_ESCAPED = re.compile(r"([<\[])(\\*)\\(/?(?:INST|SYS|s)[>\]])")
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)

FORMATTED = "conv_id long, part int, n_turns int, formatted string, loss_starts array<int>, loss_lengths array<int>"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column.cast(pa.large_string()), _CONTROL, r"\1\2\\\3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _copy(out: np.ndarray, at: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> None:
    """Each row's bytes to its place."""
    n = np.diff(offsets)
    if n.sum():
        out[np.repeat(at - offsets[:-1], n) + np.arange(offsets[0], offsets[-1])] = data[offsets[0] : offsets[-1]]


def _put(out: np.ndarray, at: np.ndarray, what: bytes) -> None:
    out[at[:, None] + np.arange(len(what))] = np.frombuffer(what, np.uint8)


def assemble(role: tuple[np.ndarray, np.ndarray], text: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, where each turn begins and the end, where each turn's text begins); columns as (offsets, bytes)."""
    r, t = np.diff(role[0]), np.diff(text[0])
    length = len(OPEN) + r + len(CLOSE) + t + len(END)
    start = np.concatenate(([0], np.cumsum(length)))
    out = np.empty(int(start[-1]), np.uint8)
    at = start[:-1]
    _put(out, at, OPEN)
    _copy(out, at + len(OPEN), *role)
    _put(out, at + len(OPEN) + r, CLOSE)
    body = at + len(OPEN) + r + len(CLOSE)
    _copy(out, body, *text)
    _put(out, body + t, END)
    return out, start, body


def format_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn. A conversation that a slice ends within goes on as its next part."""
    last, part = object(), 0
    for b in batches:
        conv = b.column("conv_id")
        role = binary_column(escape(b.column("role").fill_null("")))
        text = binary_column(escape(b.column("text").fill_null("")))
        trained = pc.equal(b.column("role").fill_null("").cast(pa.binary()), TRAINED).to_numpy(zero_copy_only=False)
        key = conv.fill_null(0).to_numpy()
        null = conv.is_null().to_numpy(zero_copy_only=False)
        for lo, hi in slices(text[0] + role[0], most_bytes=SLICE_BYTES):
            out, start, body = assemble((role[0][lo : hi + 1], role[1]), (text[0][lo : hi + 1], text[1]))
            k, z = key[lo:hi], null[lo:hi]
            cut = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]) | (z[1:] != z[:-1])) + 1, [hi - lo]))
            chars = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
            group = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            base = chars[start[cut[:-1]]][group]
            mine = trained[lo:hi]
            begin, end = chars[body] - base, chars[start[1:] - len(END)] - base
            ends = np.concatenate(([0], np.cumsum(np.bincount(group[mine], minlength=len(cut) - 1)))).astype(np.int32)
            parts = np.zeros(len(cut) - 1, np.int32)
            ids = [None if z[i] else int(k[i]) for i in cut[:-1]]
            part = part + 1 if ids[0] == last else 0
            parts[0] = part
            part = part if len(ids) == 1 else 0
            last = ids[-1]
            formatted = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(start[cut].astype(np.int32)), pa.py_buffer(out)])
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[mine].astype(np.int32))) for x in (begin, end - begin)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts), pa.array(np.diff(cut).astype(np.int32)), formatted, *lists], ["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_lengths"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns: (conv_id, turn, role, text). Returns conv_id, part, n_turns, formatted, loss_starts, loss_lengths (code
    points within formatted), sorted within partitions; a conversation is its parts in order, mostly one.

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have one order. Null roles and
    texts are empty; only the role `assistant` is trained on. A null conv_id is one conversation. Other columns are
    ignored. A conversation is one task's, which streams it: a part is about SLICE_BYTES of texts or one turn, and no
    more is held, however long the conversation is."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"]
    dealt = bounded(turns).select(*cols).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(format_scan, FORMATTED)


def digest_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads parts back; one row a conversation."""
    now, done = None, []

    def finish() -> None:
        if now:
            done.append((now["id"], now["turns"], now["all"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["length"]))

    def send() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        done.clear()
        return out

    for b in batches:
        for r in b.to_pylist():
            if r["part"] == 0:
                finish()
                now = {"id": r["conv_id"], "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "length": 0}
            text = r["formatted"]
            at = 0
            for m in _TURN.finditer(text):
                if m.start() != at:
                    raise ValueError(f"conversation {r['conv_id']}: text between turns")
                at = m.end()
                now["all"].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                now["turns"] += 1
            if at != len(text):
                raise ValueError(f"conversation {r['conv_id']}: text after the last turn")
            for s, n in zip(r["loss_starts"], r["loss_lengths"], strict=True):
                trained = unescape(text[s : s + n])
                now["loss"].update(trained.encode())
                now["chars"] += len(trained)
            now["length"] += len(text)
        if len(done) > 1000:
            yield send()
    finish()
    yield send()


def read_back(formatted: DataFrame) -> DataFrame:
    """What format_conversations returned, read back from its bytes: conv_id, n_turns, turns_sha256 (over role, \\n,
    text, \\n of each turn), loss_chars, loss_sha256 (of all trained text), formatted_chars."""
    return bounded(formatted).mapInArrow(digest_scan, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
