"""Layouts with fewer values than entities: replacements grow until all differ."""

import re
import string

import pytest

from linkloom.llm import surrogates

from .test_text_operators import frame


def test_many_short_addresses_at_one_domain(spark):
    rows = [(i, f"{c}@x.com") for i, c in enumerate(string.ascii_lowercase + string.digits)]
    out = surrogates.replace_entities(frame(spark, rows), "k").collect()
    assert len({r.text for r in out}) == len(rows) and all(re.fullmatch(r"\w+@mail[0-9a-f]{8}\.example\.com", r.text) for r in out)


def test_error_where_none_is_left(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(surrogates, "_stream", lambda key, *what: F.lit("0" * 256))
    monkeypatch.setattr(surrogates, "MOST_ATTEMPTS", 3)
    with pytest.raises(RuntimeError, match="coincide"):
        surrogates.replace_entities(frame(spark, [(1, "77.1.2.3"), (2, "77.1.2.4")]), "k")


def test_names_grow(spark):
    from pyspark.sql import functions as F

    m = spark.createDataFrame([("Mrs. Anna Smith", "f"), ("Herr Müller", "m"), ("г-жа Иванова", "f")], "m string, g string").withColumn("x", F.struct("m", F.lit("name").alias("kind"), "g"))
    rows = m.select("m", *[surrogates.surrogate(F.col("x"), lambda e, a=a: F.lit(a), "k").alias(str(a)) for a in (0, 8, 40)]).collect()
    assert all(len(r["0"]) < len(r["8"]) < len(r["40"]) for r in rows)
