"""The stored index against plain searches, and what it reads."""

import glob
import random
import unicodedata

import pyarrow.parquet as pq
import pytest

from linkloom.sources import title_index

from .conftest import files_read

TITLES = ["Über den Wolken", "uber alles", "ÜBERALL", "Éclair", "eclipse", "Ecole", "straße", "Łódź", "naïve Bayes", "Naive", "", "ﬁne print", "東京 tower", "x"]


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn").lower()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    draw = random.Random(1)
    made = [" ".join("".join(draw.choice("aeést") for _ in range(draw.randint(1, 6))) for _ in range(draw.randint(1, 4))) for _ in range(3000)]
    rows = [*enumerate(TITLES + made), (9000, None), (9001, "Naive")]
    path = str(tmp_path_factory.mktemp("index"))
    title_index.build(spark.createDataFrame(rows, "idx long, title string"), path)
    return path, [(i, t) for i, t in rows if t is not None]


@pytest.mark.parametrize("prefix", ["über", "UBER", "ec", "Éc", "s", "", "naive", "strasse", "fi", "東", "zzz", "é s"])
def test_prefix(spark, index, prefix):
    path, rows = index
    want = sorted((plain(t), i, t) for i, t in rows if plain(t).startswith(plain(prefix)))[:8]
    assert [tuple(r) for r in title_index.prefix_search(spark, path, prefix).collect()] == [(i, t) for _, i, t in want]


@pytest.mark.parametrize("query", ["uber", "Alles ub", "e", "te se a", "Tower 東", "naïve", "é", " ", "nothing"])
def test_words(spark, index, query):
    path, rows = index
    import re

    words = [w for w in plain(query).split()]
    tokens = lambda t: [x for x in re.split(r"[\W_]+", plain(t)) if x]
    want = sorted(i for i, t in rows if words and all(any(x.startswith(w) for x in tokens(t)) for w in words))
    assert [r.idx for r in title_index.word_search(spark, path, query, None).orderBy("idx").collect()] == want
    assert [r.idx for r in title_index.word_search(spark, path, query).collect()] == want[:10]


def test_only_the_files_of_a_prefix_are_read(spark, index):
    path, _ = index
    every = len(glob.glob(f"{path}/titles/rows/file=*/*.parquet"))
    assert every == title_index.LEAST_FILES
    assert files_read(title_index.prefix_search(spark, path, "uber")) == 1
    assert files_read(title_index.prefix_search(spark, path, "a", 5)) <= 2
    assert files_read(title_index.word_search(spark, path, "wolk")) == 1
    assert files_read(title_index.prefix_search(spark, path, "zzz")) <= 1


def test_blocks_are_front_coded_and_delta_packed(index):
    path, _ = index
    for part, key in (("titles", "fold"), ("words", "word")):
        meta = pq.ParquetFile(glob.glob(f"{path}/{part}/rows/file=0/*.parquet")[0]).metadata.row_group(0)
        coded = {meta.column(i).path_in_schema: meta.column(i).encodings for i in range(meta.num_columns)}
        assert "DELTA_BYTE_ARRAY" in coded[key] and "DELTA_BINARY_PACKED" in coded["idx"]


def test_empty(spark, tmp_path):
    title_index.build(spark.createDataFrame([], "idx long, title string"), str(tmp_path / "i"))
    assert title_index.prefix_search(spark, str(tmp_path / "i"), "a").count() == 0
    assert title_index.word_search(spark, str(tmp_path / "i"), "a").count() == 0
