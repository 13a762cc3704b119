"""Surrogates for personal data: detected entities receive keyed replacements of the same type.

One regular expression finds e-mail addresses, phone numbers (international with or without separators, and the national
forms of the US, UK, Germany, France and Spain), card and account numbers, IPv4 addresses, IBANs, US social security
numbers, secrets, and names after a title; names found so are also looked for without it in the same text. What is found
is made of entities: a name of a given and a family name, an address of a mailbox and a domain. An entity's canonical
form drops separators and case, so that all ways of writing it are one entity; its replacement is drawn from a keyed
hash (HMAC of SHA-512) of type, canonical form and attempt, and laid out on the surface form: digits for digits, letters
for letters of the same script and case, separators kept. Phone numbers keep the country code or the leading 0, IBANs the
country, secrets their prefix; IBANs and card numbers get right check digits; addresses get valid octets; e-mail
addresses keep the top-level domain, under a name reserved for examples; names keep the title, and a given name matches
its gender and script. So "Mr. John Smith", "Mr. Smith", "John Smith" and "Smith" in a text stay one person.

Distinct entities stay distinct: over the distinct entities of the whole input, replacements that coincide with each
other or with a real entity (given names aside) are drawn again with the next attempt, until none coincide; after some
attempts they grow longer, so that layouts with few values (one-letter addresses) suffice. Only those few exceptions are
carried to the texts, by the hash of the text they stand in. Only DataFrame expressions run on the executors."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

_L = r"\p{L}\p{N}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES_M = r"Mr\.?|Mister|Sir|Herrn?|Hr\.|Monsieur|M\.|Señor|Sr\.?|Don|D\.|Signor|г-н|Г-н|Κύριος|Κύριε|κ\."
_TITLES_F = r"Mrs\.?|Ms\.?|Miss|Lady|Frau|Fräulein|Madame|Mme\.?|Mademoiselle|Mlle\.?|Señora|Sra\.?|Señorita|Srta\.?|Doña|D\.ª|Dra\.?|Doctora|Profesora|Profa\.?|Signora|г-жа|Г-жа|Κυρία"
#: Titles of either gender; they may also follow another title.
_TITLES_N = r"Mx\.?|Dr\.?|Doctor|Doktor|Docteur|Prof\.?|Professor|Professorin|Professeure?|Profesor|Maître|Rev\.?"
_TITLED = rf"(?:{_TITLES_M}|{_TITLES_F}|{_TITLES_N})(?: (?:{_TITLES_N}))*"
_NAME = r"\p{Lu}[\p{L}'’\-]*\p{L}"
PATTERN = "|".join(
    [
        rf"(?<![{_L}._%+\-])[{_L}._%+\-]++@(?:[{_L}\-]+\.)+\p{{L}}{{2,}}",
        rf"(?<![{_L}])(?:AKIA[0-9A-Z]{{16}}|ghp_[0-9A-Za-z]{{36}}|sk-[0-9A-Za-z]{{20,}}+|[0-9a-f]{{32,}}+|[0-9A-F]{{32,}}+)(?![{_L}])",
        rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
        r"(?<![\p{L}\d])\+\d(?:[ \u00A0\u202F.\-/()]{0,2}\d){6,14}(?!\d)",
        r"(?<![\p{L}\d+])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)",
        r"(?<![\p{L}\d])\+\d{1,3}(?:[ .\-]\d{2,4}){2,4}(?!\d)",
        r"(?<![\p{L}\d])\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d)",
        r"(?<![\p{L}\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
        rf"(?<![{_L}])[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?![{_L}])",
        r"(?<![\p{L}\d])\d(?:[ \-]?\d){12,18}(?!\d)",
        r"(?<![\p{L}\d])(?<!\d[., \-])\d{3} \d{3} \d{4}(?!\d)",
        # national: 0 and pairs (France), 0, area and number (Germany, UK), nine digits (Spain)
        r"(?<![\p{L}\d])(?<!\d[.,/\-])0[1-9](?<sep>[ \u00A0\u202F.\-]?)\d{2}(?:\k<sep>\d{2}){3}(?!\d)",
        r"(?<![\p{L}\d])(?<!\d[.,/\-])(?=(?:[ /()\-]{0,3}\d){8})(?:\(0[1-9]\d{1,4}\) ?|0[1-9]\d{1,4}(?: ?[/\-] ?| ))(?:\d{5,9}(?:-\d{1,4})?|\d{2,5}(?:[ \-]\d{1,5}){1,4})(?!\d)",
        r"(?<![\p{L}\d])(?<!\d[.,/\-])0[1-9]\d{8,10}(?!\d)",
        r"(?<![\p{L}\d])(?<!\d[.,/\- ])(?:[6-9]\d{8}|[6-9]\d{2}(?: \d{3} \d{3}|-\d{3}-\d{3}| \d{2} \d{2} \d{2}|-\d{2}-\d{2}-\d{2})|[89]\d \d{3} \d{2} \d{2})(?![.,]?\d)",
        rf"(?<!\p{{L}}){_TITLED} {_NAME}(?: {_NAME})?",
    ]
)
#: A text without any of these holds no entity.
QUICK = rf"[0-9@]|sk-|AKIA|ghp_|[a-f]{{32}}|[A-F]{{32}}|(?<!\p{{L}}){_TITLED} \p{{Lu}}"
#: A number's country code.
_COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Louis Marco Nils Oscar Paul Ralf Simon Theo Victor".split(),
    ("latin", "f"): "Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Katja Laura Maria Nora Olga Paula Rosa Sofia Tina Vera".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Ηλίας Θανάσης Κώστας Λάμπρος Μιχάλης Νίκος Πέτρος".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δέσποινα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία".split(),
}
#: Syllables of surnames by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta to".split(),
    "cyrillic": "ба бо ва ве да де за зо ка ко ла ле ма ме на но па пе ра ро са се та то ша шо".split(),
    "greek": "βα βο γα γε δα δε ζα ζο κα κο λα λε μα με να νο πα πε ρα ρο σα σε τα το φα φο".split(),
}
#: Endings of surnames of women, by script.
ENDINGS = {"latin": "", "cyrillic": "ва", "greek": ""}
#: Titles that are words or initials as well: after one, only a given and a family name together count without a title.
_UNSURE = r"M\.|D\.|Don|Sir|Miss|Lady|Rev\.?"
#: Rows of exceptions that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 20_000
#: Attempts from which on replacements grow by a digit or syllable an attempt, for layouts with few values; then those
#: after which an error is raised (addresses do not grow).
GROW_FROM, MOST_ATTEMPTS = 8, 200


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^(AKIA[0-9A-Z]{16}|ghp_.*|sk-.*|[0-9a-f]{32,}|[0-9A-F]{32,})$") & ~m.rlike(r"^\d{1,19}$"), "secret")
        .when(m.rlike(r"^\+|^\("), "phone")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^(?:\D*\d){13}"), "account")
        .when(m.rlike(r"^\d"), "phone")
        .otherwise("name")
    )


def _name_part(m: Column) -> Column:
    return F.regexp_replace(m, rf"^{_TITLED} ", "")


def _gender(m: Column) -> Column:
    return F.when(m.rlike(rf"^(?:{_TITLES_F}) "), "f").when(m.rlike(rf"^(?:{_TITLES_N}) "), "n").otherwise("m")


def _flat(m: Column) -> Column:
    return F.lower(F.regexp_replace(m, r"[^\p{L}\p{N}]", ""))


def _canon(m: Column, kind: Column) -> Column:
    """One form for all ways of writing an entity."""
    return F.when(kind.isin("email", "domain", "given", "family"), F.lower(m)).when(kind == "ip", m).otherwise(_flat(m))


def _entity(kind: str | Column, surface: Column, gender: str | Column = "") -> Column:
    """(kind, canonical form, surface, gender). Given names are kept apart by gender, and family names where it ends them."""
    kind, gender = (F.lit(x) if isinstance(x, str) else x for x in (kind, gender))
    apart = F.when((kind == "given") | ((kind == "family") & (gender == "f") & surface.rlike(r"\p{IsCyrillic}")), F.concat(gender, F.lit(":"))).otherwise("")
    return F.struct(kind.alias("kind"), F.concat(apart, _canon(surface, kind)).alias("canon"), surface.alias("surface"), gender.alias("g"))


def _entities(m: Column) -> Column:
    """The entities that a match (m, kind, g) is made of, in order."""
    def of_name(part: Column) -> Column:
        words = F.split(part, " ")
        family = _entity("family", F.element_at(words, -1), m["g"])
        return F.when(F.size(words) > 1, F.array(_entity("given", words[0], m["g"]), family)).otherwise(F.array(family))

    return (
        F.when(m["kind"] == "name", _let(_name_part(m["m"]), of_name))
        .when(m["kind"] == "email", F.array(_entity("email", m["m"]), _entity("domain", F.substring_index(m["m"], "@", -1))))
        .otherwise(F.array(_entity(m["kind"], m["m"])))
    )


def _stream(key: str, *what: Column) -> Column:
    """256 keyed hex digits: HMAC with SHA-512, twice."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in raw)) for pad in (0x36, 0x5C))
    text = F.concat_ws("|", *what)
    mac = lambda k: F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(F.concat(F.lit(f"{k}|"), text), "utf-8")), 512))), 512)
    return F.concat(mac(0), mac(1))


def _number(stream: Column, at: int, of: int) -> Column:
    return (F.conv(F.substring(stream, at + 1, 8), 16, 10).cast("long") % of).cast("int")


def _laid_out(surface: Column, stream: Column) -> Column:
    """The k-th letter or digit of the surface replaced by one of its kind, drawn by the k-th digit of the stream."""
    drawn = F.struct(
        F.translate(stream, "abcdef", "380527").alias("digit"), F.translate(stream, "0123456789abcdef", "ghjkmnpqrstvwxyz").alias("latin"),
        F.translate(stream, "0123456789abcdef", "бвгджзклмнпрстфх").alias("cyrillic"), F.translate(stream, "0123456789abcdef", "βγδζηθικλμνπρστφ").alias("greek"),
    )

    def lay(d: Column) -> Column:
        def put(acc: Column, c: Column) -> Column:
            at = (acc["k"] % 256 + 1).cast("int")
            of = lambda name: F.substr(d[name], at, F.lit(1))
            letter = F.when(c.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(c.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))
            cased = F.when(c.rlike(r"\p{Lu}"), F.upper(letter)).otherwise(letter)
            new = F.when(c.rlike(r"^\p{N}$"), of("digit")).when(c.rlike(r"^\p{L}$"), cased).otherwise(c)
            return F.struct(F.concat(acc["out"], new).alias("out"), (acc["k"] + F.when(c.rlike(r"^[\p{L}\p{N}]$"), 1).otherwise(0)).alias("k"))

        return F.aggregate(F.split(surface, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), put, lambda acc: acc["out"])

    return _let(drawn, lay)


def _hex_out(surface: Column, stream: Column) -> Column:
    n = F.length(surface)
    lower = F.substr(F.repeat(stream, F.ceil(n / 256).cast("int")), F.lit(1), n)
    return F.when(surface.rlike("[A-F]"), F.upper(lower)).otherwise(lower)


def _with_luhn(number: Column) -> Column:
    """A number that ends in a digit, the last replaced by the check digit of those before it."""
    def check(digits: Column) -> Column:  # from the last but one backwards, every other digit doubled
        total = F.aggregate(
            F.split(F.substr(F.reverse(digits), F.lit(2), F.length(digits)), ""), F.struct(F.lit(0).alias("sum"), F.lit(True).alias("twice")),
            lambda acc, d: F.struct((acc["sum"] + F.when(acc["twice"], F.coalesce(d.cast("int"), F.lit(0)) * 2 - F.when(d >= "5", 9).otherwise(0)).otherwise(F.coalesce(d.cast("int"), F.lit(0)))).alias("sum"), (~acc["twice"]).alias("twice")),
            lambda acc: acc["sum"],
        )
        return ((F.lit(10) - total % 10) % 10).cast("string")

    return F.concat(F.substr(number, F.lit(1), F.length(number) - 1), _let(F.regexp_replace(number, r"\D", ""), check))


def _with_mod97(iban: Column) -> Column:
    """An IBAN with the check digits, its third and fourth character, of the rest."""
    moved = F.upper(F.concat(F.regexp_replace(F.substr(iban, F.lit(5), F.length(iban)), " ", ""), F.substr(iban, F.lit(1), F.lit(2)), F.lit("00")))
    value = lambda c: F.when(c.rlike(r"^\d$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(c.rlike(r"^\d$"), 10).otherwise(100) + value(c)) % 97)
    return F.concat(F.substr(iban, F.lit(1), F.lit(2)), F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), F.substr(iban, F.lit(5), F.length(iban)))


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def _by_script(surface: Column, body) -> Column:
    return F.when(surface.rlike(r"\p{IsCyrillic}"), body("cyrillic")).when(surface.rlike(r"\p{IsGreek}"), body("greek")).otherwise(body("latin"))


def _syllables(name: str, stream: Column, n: Column) -> Column:
    """The first n of 16 drawn syllables, any more from the start again."""
    of = F.array(*map(F.lit, SYLLABLES[name]))
    drawn = F.array(*[F.element_at(of, _number(stream, 16 + 8 * k, len(SYLLABLES[name])) + 1) for k in range(16)])
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.element_at(drawn, (k - 1) % 16 + 1)), "")


def _family(surface: Column, g: Column, stream: Column, more: Column) -> Column:
    return _by_script(surface, lambda name: F.concat(F.initcap(_syllables(name, stream, more + 4)), F.when(g == "f", ENDINGS[name]).otherwise("")))


def _given(surface: Column, g: Column, stream: Column, attempt: Column) -> Column:
    """One of the script's and gender's names; from the first further attempt on two, then syllables besides."""
    def script(name: str) -> Column:
        men, women = GIVEN[name, "m"], GIVEN[name, "f"]
        drawn = lambda values, at: _pick(values, _number(stream, at, len(values)))
        of = lambda at: F.when(g == "f", drawn(women, at)).when(g == "n", drawn(men + women, at)).otherwise(drawn(men, at))
        second = F.concat(of(0), F.lit("-"), of(8))
        return F.when(attempt == 0, of(0)).when(attempt < 3, second).otherwise(F.concat(second, _syllables(name, stream, attempt - 2)))

    return _by_script(surface, script)


def drawn(e: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity (see _entity) at an attempt: of an address the mailbox, of a domain all of it."""
    return _let(_stream(key, e["kind"], e["canon"], attempt.cast("string")), lambda stream: _drawn(e["kind"], e["surface"], e["g"], stream, attempt))


def _drawn(kind: Column, m: Column, g: Column, stream: Column, attempt: Column) -> Column:
    # by how many digits or syllables the replacement is longer than its layout
    more = F.greatest(attempt - GROW_FROM + 1, F.lit(0))
    digits = F.when(more > 0, F.substr(F.reverse(F.translate(stream, "abcdef", "380527")), F.lit(1), more)).otherwise("")
    ip = F.concat_ws(".", (_number(stream, 0, 223) + 1).cast("string"), *[_number(stream, 8 * k, 256).cast("string") for k in (1, 2, 3)])
    prefix = F.when(kind == "phone", F.regexp_extract(m, rf"{_COUNTRY}|^\(?0", 0)).when(kind == "iban", F.substring(m, 1, 2)).when(kind == "secret", F.regexp_extract(m, "^(AKIA|ghp_|sk-)", 0)).otherwise("")
    rest = F.substr(m, F.length(prefix) + 1, F.length(m))
    shaped = F.concat(prefix, F.when((kind == "secret") & (F.length(prefix) == 0), _hex_out(rest, stream)).otherwise(_laid_out(rest, stream)), digits)
    return (
        F.when(kind == "email", F.concat(_laid_out(F.substring_index(m, "@", 1), stream), digits))
        .when(kind == "domain", F.concat(F.lit("mail"), F.substring(stream, 1, 8), F.lit(".example."), F.substring_index(m, ".", -1)))
        .when(kind == "ip", ip).when(kind == "family", _family(m, g, stream, more)).when(kind == "given", _given(m, g, stream, attempt))
        .when(kind == "account", _with_luhn(shaped)).when(kind == "iban", _let(shaped, _with_mod97)).otherwise(shaped)
    )


def surrogate(m: Column, attempt, key: str) -> Column:
    """The replacement of a match (m, kind, g); attempt: a function from an entity to its attempt."""
    def put(parts: Column) -> Column:
        name = F.concat(F.substr(m["m"], F.lit(1), F.length(m["m"]) - F.length(_name_part(m["m"]))), F.array_join(parts, " "))
        return F.when(m["kind"] == "name", name).when(m["kind"] == "email", F.array_join(parts, "@")).otherwise(parts[0])

    return _let(F.transform(_entities(m), lambda e: drawn(e, attempt(e), key)), put)


def _untitled(found: Column) -> Column:
    """What names after a title may also be called in their text: an array of (as, gender), longer ones first."""
    titled = F.filter(found, lambda m: _kind(m) == "name")
    whole = F.transform(titled, lambda m: F.struct(_name_part(m).alias("as"), _gender(m).alias("g"), m.rlike(rf"^(?:{_UNSURE}) ").alias("unsure")))
    whole = F.filter(whole, lambda n: ~(n["unsure"] & ~n["as"].contains(" ")))
    family = F.transform(F.filter(whole, lambda n: ~n["unsure"]), lambda n: F.struct(F.element_at(F.split(n["as"], " "), -1).alias("as"), n["g"].alias("g"), n["unsure"].alias("unsure")))
    return F.array_distinct(F.transform(F.concat(F.filter(whole, lambda n: n["as"].contains(" ")), F.filter(family, lambda n: F.length(n["as"]) > 2)), lambda n: F.struct(n["as"].alias("as"), n["g"].alias("g"))))


def _pattern(names: Column) -> Column:
    quoted = F.array_join(F.transform(names, lambda n: F.concat(F.lit(r"\Q"), n["as"], F.lit(r"\E"))), "|")
    return F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])"))


def with_matches(docs: DataFrame, names: str, matches: str) -> DataFrame:
    """docs with two columns more: names that are looked for without a title, and all matches (m, kind, g) of text."""
    text = F.col("text")
    first = F.when(text.rlike(QUICK), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # of the names after a title those that stand elsewhere in the text too
    times = lambda c, word: F.length(c) - F.length(F.replace(c, word, F.lit("")))
    called = F.when(F.exists(F.col(matches), lambda m: m.rlike(rf"^{_TITLED} ")), F.filter(_untitled(F.col(matches)), lambda n: times(text, n["as"]) > times(F.array_join(matches, "\n"), n["as"])))
    all_of = F.when(F.size(names) > 0, F.regexp_extract_all(text, _pattern(F.col(names)), F.lit(0))).otherwise(F.col(matches))

    def known(m: Column) -> Column:
        """The gender of a name without a title; null for all else."""
        return F.when(F.size(names) > 0, F.get(F.filter(F.col(names), lambda n: n["as"] == m), F.lit(0))["g"])

    def described(m: Column) -> Column:
        return _let(known(m), lambda g: _let(F.when(g.isNotNull(), "name").otherwise(_kind(m)), lambda kind: F.struct(m.alias("m"), kind.alias("kind"), F.when(kind == "name", F.coalesce(g, _gender(m))).otherwise("").alias("g"))))

    return docs.withColumn(matches, first).withColumn(names, called).withColumn(matches, F.transform(all_of, described))


def exceptions(found: DataFrame, key: str, scratch: Scratch) -> DataFrame | None:
    """found: (kind, canon, surface, g) of all entities. Returns kind, canon, attempt of those that need an attempt over
    0; None if none.

    An entity whose replacement is that of a smaller entity, or is a real entity, goes on to the next attempt."""
    entities = found.groupBy("kind", "canon").agg(F.min("surface").alias("surface"), F.min("g").alias("g"))
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df: df.repartition(parts, "kind", "canon")  # noqa: E731  few bytes but much work a row: not one task's
    now = scratch.save(spread(entities.withColumn("attempt", F.lit(0))))
    real = now.where("kind not in ('given', 'email')").select("kind", F.when(F.col("kind") == "family", F.lower("surface")).otherwise(F.col("canon")).alias("to")).distinct()
    to = drawn(F.struct("kind", "canon", "surface", "g"), F.col("attempt"), key)
    # mailboxes are told apart within their domain
    to = _let(to, lambda x: F.when(F.col("kind") == "email", F.concat(F.lower(x), F.lit("@"), F.lower(F.substring_index("surface", "@", -1)))).otherwise(_canon(x, F.col("kind"))))
    for number in range(MOST_ATTEMPTS):
        drew = scratch.save(now.withColumn("to", to))
        first = drew.groupBy("kind", "to").agg(F.min_by("canon", F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n"))
        twice = first.where("n > 1").drop("n")
        taken = first.select("kind", "to").join(real, ["kind", "to"], "left_semi").withColumn("first", F.lit(None).cast("string"))
        bad = drew.join(twice.unionByName(taken), ["kind", "to"]).where("first is null or canon <> first").select("kind", "canon").distinct()
        step = scratch.save(bad)
        scratch.drop(drew)
        if step.isEmpty():
            break
        if number + 1 == MOST_ATTEMPTS:
            raise RuntimeError(f"replacements still coincide after {MOST_ATTEMPTS} attempts, as for {step.first()}")
        now = scratch.save(spread(now.join(step.withColumn("again", F.lit(1)), ["kind", "canon"], "left").select("kind", "canon", "surface", "g", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))))
    moved = now.where("attempt > 0").select("kind", "canon", "attempt")
    return None if moved.isEmpty() else moved


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """docs: any columns with `text`. Returns the same columns and rows with entities in text replaced, and n_entities.

    Null stays null, with 0 entities; empty and clean texts stay as they are. Repeated rows are replaced alike, and so
    is an entity in all texts. Where there are no entities nothing changes. Columns of the input are kept under their
    names, whatever these are, n_entities aside, which is replaced. Texts are rewritten within their rows: long texts
    cost in proportion to their length, and nothing of the texts is shuffled unless very many hold an exception."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "surrogates")
    own = uuid.uuid4().hex
    names, matches, th, mine, changes, entity = (f"{x}_{own}" for x in ("names", "matches", "th", "mine", "changes", "entity"))
    # outer: for an inner one the planner would put the search for matches into a filter of its own as well
    found = with_matches(docs.select("text"), names, matches).select(F.xxhash64("text").alias("th"), F.explode_outer(matches).alias("m")).where("m is not null")
    found = scratch.save(found.groupBy("th", "m").agg(F.count("*").alias("n")).select("th", F.explode(_entities(F.col("m"))).alias(entity)).select("th", f"{entity}.*").distinct())
    moved = exceptions(found.drop("th"), key, scratch)
    cols = [c for c in docs.columns if c != "n_entities"]
    out = with_matches(docs, names, matches)
    if moved is None:
        attempt = lambda e: F.lit(0)
    else:
        fix = found.join(moved, ["kind", "canon"]).groupBy("th").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias(changes))
        fix = scratch.save(fix.withColumnRenamed("th", th))
        fix = F.broadcast(fix) if fix.count() <= BROADCAST_ROWS else fix
        # rows without a match look nothing up, and so are no hot key
        out = out.withColumn(mine, F.when(F.size(matches) > 0, F.xxhash64("text")).otherwise(-F.monotonically_increasing_id()))
        out = out.join(fix, F.col(mine) == F.col(th), "left")
        attempt = lambda e: F.coalesce(F.element_at(F.col(changes), F.concat_ws("|", e["kind"], e["canon"])), F.lit(0))
    put = F.transform(matches, lambda m: surrogate(m, attempt, key))
    between = F.when(F.size(names) > 0, F.split(F.col("text"), _pattern(F.col(names)), F.lit(-1))).otherwise(F.split(F.col("text"), PATTERN, -1))
    joined = F.array_join(F.zip_with(between, put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.size(matches) > 0, joined).otherwise(F.col("text"))
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in cols], F.greatest(F.size(matches), F.lit(0)).alias("n_entities"))
