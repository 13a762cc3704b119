"""Operators on texts against plain versions, with null, empty, long and repeated texts, empty tables, extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.llm import chat, decontamination, jaccard_join, language_model, licences, quality, surrogates, token_counts

from ..conftest import DATA

SCHEMA = "doc_id long, text string, source string, score double, rows long"  # names that operators use themselves
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "É the THE the\x0bcat"), (6, "long word " * 30000), (None, "no id here at all")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 0.5, 1) for i, t in rows], SCHEMA)


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


# ---- language model
def test_language_model(spark):
    docs = [(i, " ".join(random.Random(i).choices("a b c d e the of".split(), k=i % 40))) for i in range(10, 200)] + ODD
    df = frame(spark, docs)
    tokens = lambda t: [*words(t), "</s>"]
    train = Counter(w for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    key = "crc32(cast(doc_id as string)) % 5 <> 1"
    full = language_model.score_language_model(df, key).collect()
    joined = language_model.score_language_model(df, key, broadcast_bytes=0, head_words=2).collect()
    want = sorted((i or -1, len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 5)) for i, t in docs)
    for out in (full, joined):
        assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in out) == want
        assert {r.train_tokens for r in out} == {n}
    by = lambda out: sorted((r.doc_id or -1, r.score) for r in out)
    assert all(abs(a[1] - b[1]) <= 0.02 * abs(b[1]) for a, b in zip(by(full), by(joined), strict=True))
    assert language_model.score_language_model(frame(spark, []), key).collect() == []


def test_filter_never_loses_an_entry():
    h = language_model.mix64(np.arange(20000, dtype=np.uint64))
    t = pa.table({"seg": pa.array(np.zeros(len(h), np.int32)), "h": pa.array(h.view(np.int64)), "n": pa.array((np.arange(len(h)) % 50 + 1).astype(np.int32))})
    built = language_model.build_segment((pa.scalar(0),), t)
    bits = np.frombuffer(built.column("bits")[0].as_py(), np.uint8)
    f = language_model.Filter(np.array([len(bits)]), bits)
    assert (f.levels(h) >= language_model.level(np.arange(len(h)) % 50 + 1)).all()
    assert (f.levels(language_model.mix64(np.arange(30000, 60000, dtype=np.uint64))) > 0).mean() < 0.01


# ---- quality
def test_quality(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    odd = frame(spark, ODD)
    out = quality.score_quality(docs.select("doc_id", "text").union(odd.select("doc_id", "text")), labels, "crc32(cast(doc_id as string)) % 4 = 2").collect()
    assert len(out) == docs.count() + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert quality.score_quality(frame(spark, []), labels.limit(0), "doc_id = 0").collect() == []
    kept = quality.keep_good(odd, labels.limit(0), "doc_id = 0", threshold=0.0)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_quality_gradients():
    r = np.random.default_rng(0)
    net = quality.Network(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    texts = [bytes(r.integers(97, 123, n).astype(np.uint8)) for n in (700, 1800)]
    off, data, y = np.array([0, 700, 2500]), np.frombuffer(b"".join(texts), np.uint8), np.array([0.0, 1.0], np.float32)
    loss = lambda: -np.mean(y * np.log(net.head(net.pool(net.blocks(quality.layout(off, data)[0])[0], quality.layout(off, data)[1])[-1])[1]) + (1 - y) * np.log(1 - net.head(net.pool(net.blocks(quality.layout(off, data)[0])[0], quality.layout(off, data)[1])[-1])[1]))
    g = net.gradients(off, data, y)
    for k, at in (("w1", (3, 2)), ("b1", (1,)), ("w2", (4,)), ("bias", (2,))):
        net.p[k][at] += 1e-3
        up = loss()
        net.p[k][at] -= 2e-3
        down = loss()
        net.p[k][at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(float(g[k][at]), abs=2e-3)


# ---- token counts
def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(0)
    alphabet = "abcdethe inrsonst  \nАбвгд中文日本éüß𝄞0123.,;!?▁<>/"
    texts = [t for _, t in ODD] + ["the" * 700, " " * 700, "x" + " " * 300 + "y", "<s> </s>", "中" * 600] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 900))) for _ in range(80)]
    out = token_counts.count_tokens(frame(spark, list(enumerate(texts))), path, 100).collect()
    assert {(x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in out} == {(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(frame(spark, []), path).collect() == []


@pytest.mark.parametrize("text", ["a" * 300_000, "ab" * 5000 + "c", "".join(random.Random(4).choices("aeinrst", k=20_000)), "日本" * 9000, "the" * 900 + " " + "the" * 900, " " * 3000, "éa" * 700])
def test_token_counts_without_reset_places(text, monkeypatch):
    """Chunks that no reset place parts: the scan gives the library's counts, and in few rounds."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m, sp = token_counts.machine(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rounds, real = [], m.run
    monkeypatch.setattr(m, "run", lambda *a: rounds.append(1) or real(*a))
    data = np.frombuffer(text.encode(), np.uint8)
    chars, first, _ = token_counts.with_spaces(np.array([0, len(data)]), data)
    assert m.count(chars, first)[0] == len(sp.encode(text)) and len(rounds) < 20


# ---- decontamination
def edit_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        cur = [i + 1]
        for j, d in enumerate(t):
            cur.append(min(prev[j] + (c != d), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_leaks_against_brute_force(spark):
    r = random.Random(1)
    items = [(k, "".join(r.choice("ab cd") for _ in range(r.randint(15, 60)))) for k in range(12)] + [(90, None), (91, ""), (92, "ab")]
    docs = []
    for i in range(60):
        t = list(r.choice(items[:12])[1])
        for _ in range(r.randint(0, 6)):
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice([[], ["x"], [t[k], "y"]])
            t = t or ["z"]
        docs.append((i, "".join(r.choice("wxyz ") for _ in range(40)) + "".join(t).upper() + "".join(r.choice("wxyz ") for _ in range(20))))
    docs += [(100, None), (101, ""), (102, "w" * 50000)]
    got = {(x.doc_id, x.item_id): x.distance for x in decontamination.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 0.12).collect()}
    want = {}
    for (i, t), (k, p) in itertools.product(docs[:60], items):
        p, t = decontamination.plain(p), decontamination.plain(t)
        if p and (d := edit_distance(p, t)) <= decontamination.budget(len(p), 0.12):
            want[i, k] = d
    assert got == want
    kept = decontamination.remove_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 0.12)
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontamination.find_leaks(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_quality_on_rows_held_out(spark):
    """The score parts good from bad texts that were not learned from: their order (AUC) and the answers at 0.7."""
    table = lambda n: spark.read.parquet(f"{DATA[: -len('sf0.001')]}sf0.01/{n}.parquet")
    out = quality.score_quality(table("documents"), table("labels"), "crc32(cast(doc_id as string)) % 4 = 2")
    rows = out.where("held_out").join(table("labels").where("quality in (0, 1)"), "doc_id").select("score", "predicted", "quality").collect()
    score, y = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    rank = score.argsort().argsort() + 1
    n1 = int(y.sum())
    auc = (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))
    assert len(rows) > 80 and auc > 0.95 and all(r.predicted == (r.score >= 0.7) for r in rows)
    assert ((score >= 0.7) == (y == 1)).mean() > 0.9


def test_quality_learns_whole_texts_within_bytes(spark, monkeypatch):
    """Repeated rows and labels, several texts under one id, long and null texts; texts that do not fit are passed over."""
    seen = []
    monkeypatch.setattr(quality.Network, "train", lambda self, texts, y: seen.append(sorted(zip(map(len, texts), y.tolist()))) or self)
    docs = [(1, "g" * 300_000), (1, "g" * 300_000), (2, "b"), (3, None), (4, "x" * 2_000_000), (5, "q"), (5, "qq"), (None, "n")]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, 1), (5, None), (6, 1), (None, 1), (2, 0)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "MOST_BYTES", 1_000_000)
    out = quality.score_quality(frame(spark, docs), labels, "false").collect()
    assert seen == [[(0, 0.0), (1, 0.0), (300_000, 1.0)]] and len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)


# ---- surrogates
def test_surrogates(spark):
    rows = [
        (1, 'Mail Éric.1@mail5.example.com or ÉRIC.1@MAIL5.EXAMPLE.COM, call +1 (743) 555-3824; 10.0.0.1, 4785 3805 9239 1139 and 4785380592391139; key "24be64439e3e49cf46b2d7c90f3602a3d0b907ff".'),
        (2, "Mrs. Anna Smith met Herr Müller and г-жа Иванова. IBAN DE44 5001 0517 5407 3249 31 ssn 123-45-6789"), (3, None), (4, ""), (5, "clean 12 of 3.4"), (6, "x " * 40000 + "a@b.org"), (7, "a@b.org"), (7, "a@b.org"),
    ]
    df = frame(spark, rows)
    out = {r.doc_id: r for r in surrogates.replace_entities(df, "k").collect()}
    assert surrogates.replace_entities(df, "k").columns == [*df.columns, "n_entities"]
    old = ["ric.1@", "RIC.1@", "743", "10.0.0.1", "4785", "24be6443", "Smith", "Müller", "Иванова", "5001", "123-45"]
    assert not [o for o in old if o in out[1].text + out[2].text]
    m = re.search(r"(\d{4}) (\d{4}) (\d{4}) (\d{4}) and (\d{16});", out[1].text)
    assert "".join(m.groups()[:4]) == m[5]
    a, b = re.findall(r"\S+@\S+\w", out[1].text)
    assert a.lower() == b.lower() and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4};", out[1].text)
    assert out[3].text is None and out[4].text == "" and out[5].text == "clean 12 of 3.4"
    assert out[6].text.endswith(out[7].text) and re.search(r"Mrs\. \w+a? \w+ met Herr \w+ and г-жа [А-я]+\.", out[2].text)
    assert surrogates.replace_entities(frame(spark, []), "k").collect() == []


def test_surrogates_stay_distinct(spark, monkeypatch):
    """With a stream that draws only few different values, later attempts part what coincides."""
    real = surrogates._stream
    monkeypatch.setattr(surrogates, "_stream", lambda key, *what: F.concat(*[F.repeat(F.substring(real(key, *what), 1, 1), 64)] * 4))
    ips = [f"77.1.2.{i}" for i in range(6)]
    out = surrogates.replace_entities(frame(spark, [(i, x) for i, x in enumerate(ips)]), "k").collect()
    assert len({r.text for r in out}) == 6 and not {r.text for r in out} & set(ips)


# ---- licences
def test_licences(spark):
    rows = [(1, "text\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!"), (3, None), (4, ""), (5, "licensed to nobody at all\n" * 2000), (6, "Licensed under CC BY-NC 4.0."), (6, "Licensed under CC BY-NC 4.0.")]
    got = [(r.doc_id, r.licence) for r in licences.licence_windows(frame(spark, rows), licences.TEMPLATES).collect()]
    assert sorted(got, key=str) == sorted([(1, "Apache-2.0"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "CC-BY-NC-4.0"), (6, "CC-BY-NC-4.0")], key=str)
    assert licences.licence_windows(frame(spark, [])).collect() == []


# ---- Jaccard join
def components(docs, w, num, den):
    sets = []
    for _, t in docs:
        x = words(t)
        sets.append(frozenset(tuple(x[i : i + w]) for i in range(len(x) - w + 1)) or (frozenset([tuple(x)]) if x else frozenset()))
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    first = {}
    for k, (i, _) in enumerate(docs):
        first[find(k)] = min(i, first.get(find(k), i))
    return sorted((i, len(sets[k]), first[find(k)] if sets[k] else i) for k, (i, _) in enumerate(docs))


@pytest.mark.parametrize("w,num,den", [(3, 90, 100), (5, 80, 100), (1, 50, 100), (2, 60, 100)])
def test_jaccard_against_brute_force(spark, w, num, den):
    r = random.Random(w)
    docs, i = [], 0
    for _ in range(25):
        base = [r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(1, 120))]
        for _ in range(r.randint(1, 8)):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = "z%d" % r.randrange(5)
            docs.append((i := i + 1, " ".join(t)))
    docs += [(500, None), (501, ""), (502, " \n"), (503, "Same Words"), (504, "same words"), (505, "q " * 30000)]
    got = jaccard_join.jaccard_components(frame(spark, docs), w, num, den).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == components(docs, w, num, den)


def test_jaccard_sizes_far_apart(spark):
    """Sets of 8 and 13 elements link at 0.6, though two bands lie between them."""
    docs = [(k * 10 + i, " ".join(f"w{k}x{j}" for j in range(n))) for k in range(20) for i, n in enumerate((8, 13, 20, 34))]
    got = jaccard_join.jaccard_components(frame(spark, docs), 1, 60, 100).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == components(docs, 1, 60, 100)
    assert all(x.component_id == x.doc_id - 1 for x in got if x.doc_id % 10 == 1)


@pytest.mark.parametrize("num", [50, 80, 90])
def test_every_linked_pair_shares_a_signature(num):
    r = np.random.default_rng(num)
    for n in [*range(2, 60), 200, 700, 2500]:
        for _ in range(20 if n < 60 else 4):
            base = r.integers(0, 1 << 48, n).astype(np.uint64)
            common = int(r.integers(int(n * num / 100 * 0.9), n + 1))
            other = np.concatenate((base[:common], r.integers(0, 1 << 48, int(r.integers(0, max(1, n - common) + 1))).astype(np.uint64)))
            both = len(np.intersect1d(base, other))
            linked = both and both * 100 >= num * (len(base) + len(other) - both)
            if linked and common < n:
                rows = np.repeat([0, 1], [n, len(other)])
                owner, sigs = jaccard_join.signatures(rows, np.concatenate((base, other)), np.array([n, len(other)]), num, 100, 1e6)
                assert len(np.intersect1d(sigs[owner == 0], sigs[owner == 1])), (n, common, len(other))
                sk = jaccard_join.sketches(rows, np.concatenate((base, other)), np.array([n, len(other)]), num, 100)
                t = pa.table({"cls": [1, 2], "n_shingles": [n, len(other)], "comp": [1, 2], "sketch": sk})
                assert jaccard_join._Rows(t, num, 100).near_pairs(np.array([0]), np.array([1])).all()


@pytest.mark.parametrize("block,head", [(3, 2), (4096, 1)])
def test_jaccard_in_blocks_and_without_broadcast(spark, monkeypatch, block, head):
    """Hot groups dealt out in blocks, ids joined in place of broadcast: the same components."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard_join, "RUN_SIGNATURES", 50)
    monkeypatch.setattr(jaccard_join, "HEAVY", head)
    r = random.Random(block)
    base = [f"w{j}" for j in range(60)]
    docs = [(i, " ".join(x if r.random() > 0.04 else f"y{r.randrange(3)}" for x in base)) for i in range(60)]
    docs += [(100 + i, "copy of one text " * 3) for i in range(20)] + [(200 + i, "") for i in range(5)]
    got = jaccard_join.jaccard_components(frame(spark, docs), 2, 80, 100).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == components(docs, 2, 80, 100)


def test_jaccard_odd_tables(spark):
    assert jaccard_join.jaccard_components(frame(spark, [])).collect() == []
    got = jaccard_join.jaccard_components(frame(spark, [(None, "a b c"), (None, None), (7, "a b c"), (7, "a b c"), (7, "x y z"), (2, "x y z")])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 0, -1), (-1, 1, -1), (2, 1, 2), (7, 1, 2), (7, 1, 7), (7, 1, 7)]


def test_keep_one(spark):
    long = " ".join(f"w{j}" for j in range(60))
    rows = [(2, "x y z"), (2, "x y z"), (7, "x y z"), (7, "a b c"), (7, "a b c"), (9, long + " end"), (8, long), (8, long + " fin"), (8, "alone"), (None, "n m"), (None, "n m"), (None, "x y z"), (4, ""), (4, ""), (5, None), (None, None)]
    out = jaccard_join.keep_one(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    got = sorted(((i, t) for i, t, *_ in out.collect()), key=str)
    assert got in [sorted([(2, "x y z"), (7, "a b c"), (8, x), (8, "alone"), (None, "n m"), (4, ""), (4, ""), (5, None), (None, None)], key=str) for x in (long, long + " fin")]
    assert jaccard_join.keep_one(frame(spark, [])).collect() == []


def test_packed_signatures():
    r = np.random.default_rng(2)
    sigs, docs = np.sort(r.integers(0, 1 << 41, 5000).astype(np.uint64)), r.integers(-5, 1 << 50, 5000)
    a, b = jaccard_join.unpack_signatures(jaccard_join.pack_signatures(sigs, docs))
    assert (a == sigs).all() and (b == docs).all()


# ---- chat
@pytest.mark.parametrize("slice_bytes", [4 << 20, 200])
def test_chat_round_trip(spark, monkeypatch, slice_bytes):
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, None, None), (1, 1, "assistant", "<\\s> <</SYS>> [\\\\INST] é ["), (1, 2, "[INST]", "x" * 900), (1, 3, "assistant", ""), (None, 0, "user", "no id"), (2, None, "assistant", "a"), (2, 5, "assistant", "b"), (2, 5, "assistant", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    b = df.select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn", "role", "text").select("conv_id", "role", "text").toArrow().combine_chunks()
    monkeypatch.setattr(chat, "SLICE_BYTES", slice_bytes)
    small = {x["conv_id"]: x for o in chat.digest_scan(chat.format_scan(iter(b.to_batches()))) for x in o.to_pylist()}
    out = {r.conv_id: r.asDict() for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert small == out and set(out) == {-7, 1, None, 2}
    for c in out:
        turns = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x in rows if i == c))
        trained = "".join(x for _, r, x in turns if r == "assistant")
        assert out[c]["n_turns"] == len(turns) and out[c]["loss_chars"] == len(trained)
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert out[c]["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []
