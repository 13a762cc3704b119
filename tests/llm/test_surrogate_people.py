"""Persons, domains and check digits: what is one stays one, what differs stays apart."""

import re

from pyspark.sql import functions as F

from linkloom.llm import surrogates

from .test_text_operators import frame


def rewritten(spark, rows):
    return {r.doc_id: r.text for r in surrogates.replace_entities(frame(spark, rows), "k").collect()}


def test_one_person_in_a_text(spark):
    out = rewritten(spark, [(1, "Mr. John Smith met Mr. Smith. John Smith left; Smith (not Smithson, blacksmith) stayed."), (2, "Mr. Smith and Frau Weber"), (3, "Smith alone has no title here"), (4, "M. The end. The cat.")])
    m = re.fullmatch(r"Mr\. (\S+) (\w+) met Mr\. (\w+)\. (\S+) (\w+) left; (\w+) \(not Smithson, blacksmith\) stayed\.", out[1])
    given, family = m[1], m[2]
    assert m[3] == m[5] == m[6] == family != "Smith" and m[4] == given != "John"
    assert out[2].startswith(f"Mr. {family} and Frau ") and out[3] == "Smith alone has no title here" and out[4].endswith(" end. The cat.")


def test_entity_to_surrogate_is_one_to_one(spark):
    people = [f"{t} {g} {f}" for t, g in (("Mr.", "John"), ("Mr.", "Paul"), ("Mrs.", "Ann"), ("Dr.", "Kim")) for f in ("Smith", "Jones", "Brown", "Weber")]
    people += [f"Mr. {chr(65 + i % 26)}{chr(97 + i // 26)}ri Stone" for i in range(120)]
    mails = [f"info@site{i}.org" for i in range(60)] + [f"{c}@one.org" for c in "abcdefgh"]
    rows = list(enumerate(people + mails))
    out = rewritten(spark, rows)
    assert len(set(out.values())) == len(rows) and not set(out.values()) & {t for _, t in rows}
    domains = {t.split("@")[1]: out[i].split("@")[1] for i, t in rows if "@" in t}
    assert len(set(domains.values())) == len(domains) == 61


def test_scripts_and_check_digits(spark):
    def luhn(s):
        d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
        return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0

    def mod97(s):
        s = s.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1

    out = rewritten(spark, [(1, "4111 1111 1111 1111"), (2, "DE89 3704 0044 0532 0130 00"), (3, "GB29 NWBK 6016 1331 9268 19"), (4, "Κύριος Νίκος Παπαδόπουλος"), (5, "г-жа Анна Иванова"), (6, "5500000000000004")])
    assert luhn(out[1]) and luhn(out[6]) and mod97(out[2]) and mod97(out[3]) and out[3].startswith("GB")
    assert re.fullmatch(r"Κύριος [\u0370-\u03ff\u1f00-\u1fff-]+ [\u0370-\u03ff]+", out[4]) and re.fullmatch(r"г-жа [А-я-]+ [А-я]+ва", out[5])


def test_names_of_columns_do_not_clash(spark):
    names = ["m", "kind", "canon", "th", "g", "surface", "attempt", "_m", "_a", "_th", "to", "n", "first", "names", "matches"]
    df = frame(spark, [(1, "write to a.b@c.org"), (2, None), (3, "")]).withColumns({c: F.lit(c) for c in names})
    out = {r.doc_id: r for r in surrogates.replace_entities(df, "k").collect()}
    assert surrogates.replace_entities(df, "k").columns == [*df.columns, "n_entities"]
    assert all(r[c] == c for r in out.values() for c in names) and "c.org" not in str(out[1]) and (out[2].n_entities, out[3].n_entities) == (0, 0)


def test_another_key_another_surrogate(spark):
    df = frame(spark, [(1, "a.person@c.org")])
    one, two = (surrogates.replace_entities(df, k).first().text for k in ("k", "l" * 200))
    assert one != two
