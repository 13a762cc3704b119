"""Licences in their usual forms: hard-wrapped, in one paragraph, inside a line, in comments."""

import random
import textwrap

from linkloom.llm import licences

from .test_text_operators import frame


def best_window(text, template):
    """Highest coefficient of any window that begins and ends with a pair of the template."""
    w, t = licences.plain(text), licences.plain(template)
    p, held = list(zip(w, w[1:])), set(zip(t, t[1:]))
    most, best = int((2 - licences.LEAST) / licences.LEAST * (len(t) - 1) + 1e-9), 0.0
    for i in range(len(p)):
        for j in range(i + 1, min(i + most, len(p)) + 1):
            s = set(p[i:j])
            best = max(best, 2 * len(s & held) / (len(s) + len(held)))
    return best


def test_licences_in_usual_forms(spark):
    of = dict(licences.TEXTS)
    wrap = lambda name, mark="": "\n".join(mark + x for x in textwrap.wrap(of[name], 70))
    noise = "some prose about the use of nothing in the house of the cat\n" * 20
    texts = {
        1: ("MIT", "Copyright 2020 someone\n\n" + wrap("MIT")), 2: ("MIT", noise + of["MIT"] + noise), 3: ("BSD-3-Clause", wrap("BSD-3-Clause").replace("copyright holder nor", "Foo Project nor")),
        4: ("BSD-2-Clause", wrap("BSD-2-Clause", " * ")), 5: ("GPL-3.0", wrap("GPL-3.0", "# ") + "\nimport os\n"), 6: ("GPL-2.0", wrap("GPL-2.0")), 7: ("LGPL-2.1", wrap("LGPL-2.1", "// ")),
        8: ("MIT", "This file is good. Released under the MIT License. Copyright 2020 someone."), 9: ("Apache-2.0", wrap("Apache-2.0", "# ")), 10: ("ISC", wrap("ISC")), 11: ("Zlib", wrap("Zlib")),
        12: ("CC-BY-NC-4.0", "a page, licensed under\nCC BY-NC 4.0, of mine"), 13: (None, noise), 14: (None, None), 15: (None, ""), 16: (None, "license"), 17: (None, "the mit license " * 3),
    }
    rows = [(i, t) for i, (_, t) in texts.items()]
    out = {r.doc_id: r for r in licences.licence_windows(frame(spark, [*rows, (None, "Released under the MIT License.")])).collect()}
    assert {i: out[i].licence for i in texts} == {i: n for i, (n, _) in texts.items()}
    assert out[None].licence == "MIT" and out[1].findings[0].line == 2 and out[2].findings[0].line == 20
    for i in (3, 5, 8):
        name, text = texts[i]
        assert abs(out[i].dice - max(best_window(text, t) for n, t in licences.TEMPLATES + licences.TEXTS if n == name and (len(t) > 150) == (i != 8))) < 1e-9
    two = licences.licence_windows(frame(spark, [(1, wrap("MIT") + "\n" + noise + "Licensed under CC BY 4.0.\n" + noise + of["MIT"])])).first()
    assert [f.licence for f in two.findings] == ["MIT", "CC-BY-4.0", "MIT"]
    assert licences.licence_windows(frame(spark, [])).collect() == []
    assert [r.licence for r in licences.licence_windows(frame(spark, rows[:1]), ()).collect()] == [None]


def test_notices_against_brute_force(spark):
    """Notices with words lost, repeated, wrapped and decorated, among other words: a finding where any window reaches the bound."""
    r = random.Random(3)
    noise = "a page about the use of cats in public and of dogs under no roof with free food".split()

    def disturbed(line):
        w = [x for x in line.split() for _ in range(r.choice((1, 1, 1, 1, 1, 1, 1, 2))) if r.random() > 0.1]
        w = r.choices(noise, k=r.randint(0, 12)) + w + r.choices(noise, k=r.randint(0, 12))
        marks = r.choice(("", " * ", "# ", "-" * 900 + " ", "\u2014 "))
        return marks + (r.choice((" ", "  ", "\n" + marks, "... ", "!! "))).join(w) + r.choice(("", " " + "-" * 900, "\n" * 30, " " + ". " * 400))

    texts = [disturbed(line) for _, line in licences.TEMPLATES for _ in range(3)] + ["\n".join([licences.TEMPLATES[0][1]] * 40), " ".join([licences.TEMPLATES[1][1]] * 40)]
    out = {x.doc_id: x for x in licences.licence_windows(frame(spark, list(enumerate(texts))), licences.TEMPLATES).collect()}
    for i, t in enumerate(texts):
        best = {(name, line): best_window(t, line) for name, line in licences.TEMPLATES}
        if max(best.values()) < licences.LEAST - 1e-9:
            assert out[i].dice is None, (i, t[:200])
        else:  # of overlapping windows the one with most of its template's pairs stays
            assert any(name == out[i].licence and abs(d - out[i].dice) < 1e-9 for (name, _), d in best.items()), (i, t[:200])
    assert len(out[len(texts) - 1].findings) == len(out[len(texts) - 2].findings) == 40
