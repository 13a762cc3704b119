"""Topics of articles by keywords: four schemes, each a table of fixed values and a rule."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import keywords

#: Topics in order, their place being their id, and the keywords of the full scheme.
FULL = (
    ("Biography & People", (
        "births", "deaths", "people", "family", "royalty", "monarch", "king", "queen", "dynasty", "biography", "founder", "politician", "peerage", "personalities", "activists", "alumni",
        "educator", "leader", "pioneer", "celebrity", "autobiography", "memoir", "singer", "actor", "actress", "musician", "director", "producer", "writer", "author", "philosopher", "theologian",
        "saint", "monk", "president", "prime minister", "governor", "statesman", "philanthropist",
    )),
    ("Science & Technology", (
        "science", "physics", "chemistry", "biology", "mathematics", "computer", "programming", "software", "technology", "space", "medicine", "engineering", "logic", "network", "academic", "discovery",
        "invention", "research", "astronomy", "internet", "electronics", "device", "algebra", "calculus", "evolution", "psychology", "neuroscience", "robotics", "artificial intelligence", "data", "statistic",
        "physicist", "chemist", "biologist", "scientist",
    )),
    ("History & Society", (
        "history", "election", "war", "military", "politics", "empire", "government", "sociology", "economy", "society", "battle", "law", "calendar", "treaty", "civilization", "revolution", "conflict", "monarchy",
        "parliament", "treaties", "ancient", "medieval", "renaissance", "industrial", "colonial", "democrac", "republic", "party", "union", "labor", "rights", "social", "diploma", "policy",
    )),
    ("Art & Culture", (
        "art", "music", "film", "television", "entertainment", "sport", "game", "literature", "paint", "theater", "show", "media", "album", "drama", "culture", "dance", "museum", "fiction", "novel", "poetry",
        "comedy", "video game", "architecture", "sculpture", "design", "fashion", "cuisine", "food", "cook", "creative", "performing", "visual", "classic", "contemporary",
    )),
    ("Philosophy & Religion", (
        "philosophy", "religion", "myth", "theology", "god", "belief", "deity", "buddhism", "christianity", "islam", "hinduism", "judaism", "ethic", "ritual", "spiritual", "church", "temple", "bible", "quran",
        "sacred", "faith", "worship", "existence", "metaphysics", "epistemology",
    )),
    ("Geography & Places", (
        "country", "city", "geography", "island", "mountain", "river", "ocean", "sea", "continent", "state", "region", "province", "border", "lake", "settlement", "capital", "valley", "coast", "town", "village",
        "landmark", "park", "territory", "district", "county", "location",
    )),
)
#: The keywords of the short scheme.
SHORT = (
    ("Biography & People", ("births", "deaths", "people", "family", "royalty", "biography", "leader", "singer", "actor", "writer", "author")),
    ("Science & Technology", ("science", "physics", "biology", "mathematics", "computer", "software", "technology", "space", "medicine")),
    ("History & Society", ("history", "election", "war", "military", "politics", "empire", "government", "sociology", "economy")),
    ("Art & Culture", ("art", "music", "film", "television", "entertainment", "sport", "game", "literature", "culture", "museum")),
    ("Philosophy & Religion", ("philosophy", "religion", "myth", "theology", "god", "belief", "buddhism", "christianity", "islam")),
    ("Geography & Places", ("cities", "countries", "mountains", "rivers", "islands", "geography", "towns", "villages", "regions")),
)
OTHER = "Other & General"
#: Words of an article's type, in the order of the rules.
TYPES = (
    ("Biography & People", ("human", "person", "man", "woman", "monarch", "politician", "saint", "author", "writer")),
    ("Science & Technology", ("science", "technology", "software", "computer", "algorithm", "disease", "medicine", "space", "star", "galaxy")),
    ("History & Society", ("history", "war", "battle", "treaty", "empire", "election", "government", "law", "revolution", "dynasty")),
    ("Art & Culture", ("film", "movie", "television", "album", "music", "song", "painting", "sculpture", "novel", "book", "sport", "game", "culture")),
    ("Philosophy & Religion", ("philosophy", "religion", "myth", "god", "deity", "spiritual", "church", "temple", "bible")),
    ("Geography & Places", ("country", "city", "island", "mountain", "river", "continent", "state", "region", "settlement")),
    (OTHER, ("website", "pornography", "service", "company", "corporation")),
)
#: Words by which a text is not about a person, and words of websites.
NO_PERSON = ("website", "company", "corporation", "organization", "service")
WEBSITES = ("website", "pornography", "pornstars", "streaming service", "social network", "dot-com")
#: Nine groups with their colours (red, green, blue) and keywords; the colour of all else.
GROUPS = (
    ("History & Society", (0.9, 0.1, 0.1), ("history", "war", "politics", "births", "deaths", "people", "century", "assassinated")),
    ("Science & Math", (0.1, 0.5, 0.9), ("physics", "biology", "chemistry", "math", "astronomy", "climatology", "radiation")),
    ("Arts & Entertainment", (0.8, 0.2, 0.8), ("music", "film", "art", "theatre", "album", "actor", "academy awards", "painting")),
    ("Geography & Nature", (0.1, 0.8, 0.2), ("geography", "country", "city", "island", "mountain", "states", "river", "ocean")),
    ("Technology", (0.1, 0.9, 0.9), ("technology", "computer", "software", "internet", "engineering", "machine")),
    ("Culture & Philosophy", (0.9, 0.6, 0.1), ("culture", "religion", "philosophy", "mythology", "mythological", "deity")),
    ("Health & Wellness", (0.9, 0.3, 0.5), ("medicine", "health", "disease", "anatomy", "medical")),
    ("Sports", (0.8, 0.8, 0.1), ("sports", "football", "baseball", "basketball", "olympics", "racing")),
    ("Business", (0.5, 0.8, 0.9), ("business", "economy", "company", "finance", "industry", "market")),
)
DIM = 0.3


def _words(words) -> Column:
    return F.array(*map(F.lit, words))


def has_any(c: Column, words) -> Column:
    return F.exists(_words(words), lambda w: F.contains(c, w))


def _best(title: Column, joined: Column, scheme) -> Column:
    """Place of the best topic (see keywords.best_topics), by one pass of an automaton over batches of texts."""
    fixed = tuple((name, tuple(words)) for name, words in scheme)

    def run(titles: pa.Array, texts: pa.Array) -> pa.Array:
        return keywords.best_topics(titles, texts, fixed)

    return F.arrow_udf(run, "int")(title, joined)


def topic_id(title: Column, cats: Column, scheme=FULL) -> Column:
    """0 to 5 by keyword scores over title and categories, 6 for all else; null titles and categories are empty."""
    title = F.lower(F.coalesce(title, F.lit("")))
    joined = F.concat(title, F.lit(" "), F.lower(F.concat_ws(" ", F.coalesce(cats, F.array().cast("array<string>")))))
    return _best(title, joined, scheme)


def topic_name(i: Column) -> Column:
    return F.coalesce(F.get(_words([n for n, _ in FULL]), i), F.lit(OTHER))


def id_of(name: Column) -> Column:
    """The id of a topic's name, 6 for any other."""
    place = F.array_position(_words([n for n, _ in FULL]), name)
    return F.when(place > 0, place - 1).otherwise(len(FULL)).cast("int")


def type_topic(kind: Column) -> Column:
    """The first rule that a word of the type meets; null where none does."""
    out, kind = None, F.lower(kind)
    for name, words in TYPES:
        out = F.when(has_any(kind, words), name) if out is None else out.when(has_any(kind, words), name)
    return out


def classify(title: Column, cats: Column, kind: Column | None = None) -> Column:
    """The topic by type; else a person, unless the words of an organisation stand there too; else a website; else the
    topic of the best score."""
    title = F.coalesce(title, F.lit(""))
    joined = F.lower(F.concat_ws(" ", title, F.concat_ws(" ", F.coalesce(cats, F.array().cast("array<string>")))))
    person = has_any(joined, FULL[0][1]) & ~has_any(joined, NO_PERSON)
    by_words = F.when(person, FULL[0][0]).when(has_any(joined, WEBSITES), OTHER).otherwise(topic_name(topic_id(title, cats)))
    return by_words if kind is None else F.coalesce(type_topic(kind), by_words)


def colour_group(cats: Column) -> Column:
    """Place of the first group of which any category holds a keyword; null where none does."""
    joined, out = F.lower(F.array_join(cats, "\n")), None
    for i, (_, _, words) in enumerate(GROUPS):
        out = F.when(has_any(joined, words), i) if out is None else out.when(has_any(joined, words), i)
    return out


def group_colour(cats: Column) -> Column:
    """(r, g, b, alpha) of the group of an article's categories; grey and nearly clear for all else."""
    colours = F.array(*[F.array(*map(F.lit, (*rgb, 0.9))) for _, rgb, _ in GROUPS])
    return F.coalesce(F.get(colours, colour_group(cats)), F.array(*map(F.lit, (DIM, DIM, DIM, 0.2))))


def first_keyword_group(cats: Column, groups: tuple[tuple[str, tuple[str, ...]], ...], default: str) -> Column:
    """The first group of a caller's own of which any category holds a keyword."""
    joined, out = F.lower(F.concat_ws(" | ", cats)), None
    for name, words in groups:
        out = F.when(has_any(joined, words), name) if out is None else out.when(has_any(joined, words), name)
    return out.otherwise(default)
