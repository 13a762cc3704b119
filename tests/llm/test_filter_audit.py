"""The filter audit against a plain run of all orders, and its polynomial by itself."""

import itertools
import random
import re

from linkloom.llm import filter_audit


def plain(docs, labels):
    words = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    smallest = {}
    for d, t, _ in docs:
        key = t or ""
        if d is not None:
            smallest[key] = min(smallest.get(key, d), d)

    def fails(d, t):
        key, w = t or "", words(t or "")
        out = ""
        out += "A" if len(w) < 100 else ""
        out += "B" if 100 * len(set(w)) < 80 * len(w) else ""
        out += "C" if 100 * len(re.findall("[A-Z]", key)) > 10 * len(key) else ""
        out += "D" if re.search(r"[#$%&*|]", key) else ""
        out += "E" if key in smallest and (d is None or d > smallest[key]) else ""
        return out

    rows, out = [(lang or "", fails(d, t), d) for d, t, lang in docs], set()
    good, toxic = ({d for d, q, x in labels if (q if k == 0 else x) == 1} for k in (0, 1))
    for part in {p for p, _, _ in rows}:
        mine = [(f, d) for p, f, d in rows if p == part]
        lines, total = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(f, d) for f, d in left if x in f]
                left = [(f, d) for f, d in left if x not in f]
                total[x] += len(gone)
                lines.append((x, (part, "".join(order), step, len(left), len(gone), sum(x in f for f, _ in mine) - len(gone), sum(f == x for f, _ in mine), sum(d in good for _, d in gone), sum(d in toxic for _, d in gone))))
        out |= {(*line, total[x]) for x, line in lines}
    return out


def test_all_orders(spark):
    draw = random.Random(3)
    docs = []
    for i in range(90):
        n = draw.choice([3, 99, 100, 101, 140])
        text = " ".join(draw.choice(["ABC", "def", f"w{k}"]) if draw.random() < draw.choice([0.1, 0.6]) else f"u{k}" for k in range(n))
        text = draw.choice([text, text, text + " #1", text.upper(), None, "", "one text that repeats", "one text that repeats | twice"])
        docs.append((i, text, draw.choice(["en", "de", None, ""])))
    docs += [(5, *docs[5][1:]), (None, "one text that repeats", "en"), (None, "alone without an id", "fr"), (None, "alone without an id", "fr")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, lang string, part string, mask int")
    got = filter_audit.audit_filters(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 4 * 600
    assert set(rows) == plain(docs, [x for x in labels if x[0] is not None])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    assert {(r.part, r.kept) for r in filter_audit.audit_filters(one, labels).where("step = 5").collect()} == {("", 0)}


def test_polynomial():
    counts = [7, 1, 0, 4, 2, 0, 3, 5]  # three filters
    r = filter_audit.Removal(counts)
    for applied in range(8):
        assert r.corner(applied) == sum(c for m, c in enumerate(counts) if m & applied)
    assert sum(r.shares()) == 6 * r.corner(7)
    assert r.shares()[0] == 6 * 1 + 3 * 4 + 3 * 0 + 2 * 5
