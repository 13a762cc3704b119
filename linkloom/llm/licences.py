"""Licence scans: windows of words of a text against licence templates by the Dice coefficient over word bigrams.

Text and templates are normalised alike: lower case, everything but letters, digits, dots within numbers and hyphens
within words is white space, line ends too, so that wrapped and decorated notices are found. A window's distinct bigrams
may reach the coefficient t with a template of b bigrams only if their number lies between t / (2 - t) * b and
(2 - t) / t * b, and only if t / (2 - t) * b of the template's stand there; a template is tried only on texts and places
that allow it. The templates, notices and whole licence texts, are a fixed list (or a bounded table given by the caller),
held as literals in the plan. Only DataFrame expressions run on the executors."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notice lines by which licences are commonly named in texts, as (licence id, line).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Whole licence texts and the usual file headers of longer licences, as (licence id, text).
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEXTS = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Least coefficient of a finding.
LEAST = 0.8
#: Templates that may be held as literals.
MOST_TEMPLATES = 2000
#: Words too common to tell texts that may hold a licence from others.
_COMMON = set("a all and any are as at be by can copy for free from have if in is it may must no not of on one or out use that the this to under was which will with work you above following person purpose program including without version".split())

_OTHER = r"(?U)[^\p{L}\p{N}.\-]+|(?<![\p{L}\p{N}])[.\-]+|[.\-]+(?![\p{L}\p{N}])"


def plain(line: str) -> list[str]:
    """A template's words, by the rule that the plan applies to lines."""
    keep = re.sub(r"[^\w.\-]+|_", " ", line.lower())
    return re.sub(r"(?<!\w)[.\-]+|[.\-]+(?!\w)", " ", keep).split()


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def anchors(known: list[tuple[list[str], int]]) -> list[str]:
    """known: (pairs, least number of them in a finding). Words of which every finding holds one at least: for each
    template, fewer of its pairs than a finding needs hold none of them."""
    chosen: list[str] = []
    for pairs, need in known:
        rest = [p for p in (q.split(" ") for q in pairs) if not set(p) & set(chosen)]
        while len(rest) >= need:
            pool = sorted({w for p in rest for w in p})
            w = max(pool, key=lambda w: (w not in _COMMON, len(w) > 2, sum(w in p for p in rest), len(w)))
            chosen.append(w)
            rest = [p for p in rest if w not in p]
    return chosen


def _apart(found: Column) -> Column:
    """Of structs with start and stop, in order, those that overlap none before them."""
    free = lambda kept, c: ~F.exists(kept, lambda g: (g["start"] <= c["stop"]) & (c["start"] <= g["stop"]))
    return F.aggregate(found, F.filter(found, lambda c: F.lit(False)), lambda kept, c: F.when(free(kept, c), F.concat(kept, F.array(c))).otherwise(kept))


def licence_windows(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES + TEXTS, least: float = LEAST) -> DataFrame:
    """docs: (doc_id, text). Returns one row per row of docs: doc_id, n_lines, findings (array of licence, dice, line
    number from 0), licence and dice (of the best finding; null without one; ties to the earlier line, then template),
    from windows of words of the whole text.

    Null and empty texts hold no finding. A template with fewer than two words is never found. Repeated rows get a row
    each; other columns are ignored; a long text is worked on within its row.

    A window begins and ends with a pair of the template and is at most (2 - t) / t times as long as it. For each pair
    it may begin with, the window of the highest coefficient (then the shortest) counts if it reaches t. Of a template's
    windows the best is taken first and those that overlap it are left; then of overlapping windows of different
    templates the one with most pairs of its template, then the highest coefficient. `line` is that of a window's first
    word. A text without any of a few words that every finding needs is not looked at further, and a template is tried
    only on a text that holds enough of its pairs. Work for a licence of n words in a text is of the order of n^3 / 3
    cheap comparisons, beside the text's length; nothing is shuffled."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; {MOST_TEMPLATES} are allowed as literals")
    small, large = least / (2 - least), (2 - least) / least
    known = []
    for k, (name, text) in enumerate(templates):
        w = plain(text)
        pairs = list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))
        if pairs:
            known.append((k, name, math.ceil(small * len(pairs) - 1e-9), int(large * (len(w) - 1) + 1e-9), pairs))
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    found_type = "array<struct<dice:double,line:int,k:int,licence:string>>"
    if not known:
        found = F.array().cast(found_type)
    else:
        literal = lambda pairs: F.split(F.lit("|".join(pairs)), r"\|")
        held = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("licence"), F.lit(need).alias("need"), F.lit(most).alias("most"), F.lit(len(p)).alias("n"), literal(p).alias("pairs")) for k, name, need, most, p in known])
        vocabulary = literal(list(dict.fromkeys(q for *_, p in known for q in p)))
        words = F.flatten(F.transform(lines, lambda x, i: F.transform(F.filter(F.split(F.regexp_replace(F.lower(x), _OTHER, " "), " "), lambda w: w != ""), lambda w: F.struct(i.alias("at"), w.alias("w")))))
        pairs_of = lambda ws: F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.concat_ws(" ", F.element_at(ws, i)["w"], F.element_at(ws, i + 1)["w"]))).otherwise(F.array().cast("array<string>"))

        def best(p: Column, t: Column, start: Column) -> Column:
            def grow(acc: Column, x: Column) -> Column:
                n = acc["n"] + F.when(x["first"], 1).otherwise(0)
                o = acc["o"] + F.when(x["first"] & x["hit"], 1).otherwise(0)
                dice = 2.0 * o / (n + t["n"])
                return _let(F.struct(n.alias("n"), o.alias("o"), dice.alias("d"), (x["hit"] & (dice > acc["dice"])).alias("up")), lambda v: F.struct(
                    v["n"].alias("n"), v["o"].alias("o"), F.when(v["up"], v["d"]).otherwise(acc["dice"]).alias("dice"),
                    F.when(v["up"], x["at"]).otherwise(acc["stop"]).alias("stop"), F.when(v["up"], v["o"]).otherwise(acc["shared"]).alias("shared"),
                ))

            marked = lambda s: F.transform(s, lambda x, i: F.struct(F.array_contains(t["pairs"], x).alias("hit"), (F.array_position(s, x) == i + 1).alias("first"), (start + i).alias("at")))
            zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("o"), F.lit(0.0).alias("dice"), F.lit(0).alias("stop"), F.lit(0).alias("shared"))
            end = F.aggregate(_let(F.slice(p, start, t["most"]), marked), zero, grow)
            return _let(end, lambda e: F.struct((-e["dice"]).alias("back"), start.alias("start"), e["stop"].alias("stop"), e["shared"].alias("shared"), t["k"].alias("k"), t["licence"].alias("licence")))

        def of_template(p: Column, hits: Column, t: Column) -> Column:
            own = F.filter(hits, lambda i: F.array_contains(t["pairs"], F.element_at(p, i)))
            starts = lambda h: F.filter(h, lambda s, x: F.coalesce(F.get(h, x + t["need"] - 1) < s + t["most"], F.lit(False)))
            windows = F.transform(_let(own, starts), lambda s: best(p, t, s))
            return _let(F.array_sort(F.filter(windows, lambda c: -c["back"] >= least - 1e-12)), _apart)

        def in_text(ws: Column, p: Column) -> Column:
            def of_shared(shared: Column) -> Column:
                near = F.filter(held, lambda t: F.size(F.array_intersect(t["pairs"], shared)) >= t["need"])
                hits = F.filter(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda i: F.array_contains(shared, F.get(p, i - 1)))
                each = _let(F.when(F.size(near) > 0, hits), lambda h: F.flatten(F.transform(near, lambda t: of_template(p, h, t))))
                ranked = F.array_sort(F.transform(each, lambda c: F.struct((-c["shared"]).alias("less"), c["back"].alias("back"), c["start"].alias("start"), c["stop"].alias("stop"), c["k"].alias("k"), c["licence"].alias("licence"))))
                return F.transform(_let(ranked, _apart), lambda c: F.struct((-c["back"]).alias("dice"), F.element_at(ws, c["start"])["at"].alias("line"), c["k"].alias("k"), c["licence"].alias("licence")))

            return _let(F.array_intersect(p, vocabulary), of_shared)

        able = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(re.escape, anchors([(p, need) for _, _, need, _, p in known])))})(?![\p{{L}}\p{{N}}])"
        found = F.when(F.lower(text).rlike(able), _let(words, lambda ws: _let(pairs_of(ws), lambda p: in_text(ws, p)))).otherwise(F.array().cast(found_type))
    out = docs.select("doc_id", F.size(lines).alias("n_lines"), F.coalesce(found, F.array().cast(found_type)).alias("f"))
    top = F.array_min(F.transform("f", lambda x: F.struct((-x["dice"]).alias("back"), x["line"].alias("line"), x["k"].alias("k"), x["licence"].alias("licence"))))
    return out.select(
        "doc_id", "n_lines",
        F.transform(F.array_sort("f", lambda a, b: F.when(a["line"] != b["line"], a["line"] - b["line"]).otherwise(a["k"] - b["k"])), lambda x: F.struct(x["licence"].alias("licence"), x["dice"].alias("dice"), x["line"].alias("line"))).alias("findings"),
        top["licence"].alias("licence"), (-top["back"]).alias("dice"),
    )
