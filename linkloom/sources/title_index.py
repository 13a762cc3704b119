"""A stored index of titles: by prefix and by the words in them, without regard to case and diacritics.

`titles` holds (fold, idx, title) in the order of the folded title and `words` (word, idx) of every distinct folded word, in that order,
each in files of a range of it. Parquet's own encodings for sorted columns make the blocks small: folded titles and
words are front-coded (each only as what differs from the one before) and numbers are packed deltas. A top level tells
the first and last entry of every file, so that a look-up opens only the files of its range and, by their footers, reads
only the pages of it. A word with very many titles fills files of its own; nothing gathers them in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file about, and files at least.
FILE_ROWS, LEAST_FILES = 2_000_000, 8
#: Front-coding and packed deltas; pages and row groups small enough to be worth skipping.
CODED = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.block.size": str(4 << 20), "parquet.page.size": str(64 << 10)}
#: Columns of the stored tables and of their top level.
STORED = {"titles": "fold string, idx long, title string, file int", "words": "word string, idx long, file int"}
TOP = "file int, first string, last string, n long"
#: After every text that begins with a prefix.
_LAST = "\U0010ffff"


def fold(column: pa.Array) -> pa.Array:
    """Texts in lower case without diacritics: compatibility forms taken apart, marks left out."""
    return pc.utf8_lower(pc.replace_substring_regex(pc.utf8_normalize(column, form="NFKD"), r"\p{Mn}", ""))


def folded(rows: DataFrame) -> DataFrame:
    """rows: (idx, title), with the column fold; rows without a title are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([fold(b.column("title")), b.column("idx"), b.column("title")], ["fold", "idx", "title"])

    return rows.where("title is not null").select(F.col("idx").cast("long").alias("idx"), "title").mapInArrow(run, "fold string, idx long, title string")


def fold_text(text: str) -> str:
    return fold(pa.array([text]))[0].as_py()


def words_of(rows: DataFrame) -> DataFrame:
    """(word, idx): the distinct folded words of titles."""
    word = F.explode(F.array_distinct(F.filter(F.split("fold", r"[^\p{L}\p{N}]+"), lambda w: w != "")))
    return rows.select(word.alias("word"), "idx")


def stored(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of an index: titles or words."""
    return spark.read.schema(STORED[kind]).parquet(f"{path}/{kind}/rows")


def _write(rows: DataFrame, kind: str, path: str, n: int) -> None:
    """rows in files by ranges of (key, idx), and the top level over them."""
    key, spark = rows.columns[0], rows.sparkSession
    files = max(LEAST_FILES, -(-n // FILE_ROWS))
    dealt = rows.repartitionByRange(files, key, "idx").withColumn("file", F.spark_partition_id())
    dealt.sortWithinPartitions("file", key, "idx").write.mode("overwrite").options(**CODED).partitionBy("file").parquet(f"{path}/{kind}/rows")
    stored(spark, path, kind).groupBy("file").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n")).coalesce(1).sortWithinPartitions("first", "file").write.mode("overwrite").parquet(f"{path}/{kind}/top")


def build(rows: DataFrame, path: str) -> None:
    """rows: (idx, title). Writes the index into a folder."""
    keyed, n = folded(rows), rows.count()
    _write(keyed, "titles", path, n)
    _write(words_of(keyed), "words", path, 4 * n)


def _range(spark: SparkSession, path: str, kind: str, prefix: str, enough: int | None = None) -> DataFrame:
    """Stored rows whose key begins with prefix. enough: of their first files only so many as surely hold that many."""
    key = STORED[kind].split()[0]
    over = spark.read.schema(TOP).parquet(f"{path}/{kind}/top").where((F.col("last") >= prefix) & (F.col("first") <= prefix + _LAST))
    if enough is not None:  # every file between the first and the last holds a row at least
        over = over.orderBy("first", "file").limit(enough + 2)
    files, sure = [], 0
    for r in over.orderBy("first", "file").collect() if enough is not None else over.select("file", "first", "last", "n").collect():
        files.append(r.file)
        sure += r.n if r.first.startswith(prefix) and r.last.startswith(prefix) else 0
        if enough is not None and sure >= enough:
            break
    found = stored(spark, path, kind)
    return found.where(F.col("file").isin(files) & F.col(key).startswith(prefix)) if files else found.where("false")


def prefix_search(spark: SparkSession, path: str, prefix: str, limit: int = 8) -> DataFrame:
    """(idx, title): the first titles that begin with prefix, in the order of folded titles, then of idx."""
    found = _range(spark, path, "titles", fold_text(prefix), limit)
    return found.orderBy("fold", "idx").limit(limit).select("idx", "title")


def word_search(spark: SparkSession, path: str, query: str, limit: int | None = 10) -> DataFrame:
    """(idx): titles that have, for each word of the query, a word that begins with it; the first by idx. No words: no
    rows."""
    words = [w for w in fold_text(query).split() if w]
    out = None
    for w in sorted(set(words), key=len, reverse=True):  # the longest, of the fewest titles, first
        mine = _range(spark, path, "words", w).select("idx")
        out = mine.distinct() if out is None else out.join(mine, "idx", "left_semi")
    if out is None:
        out = stored(spark, path, "words").select("idx").where("false")
    return out if limit is None else out.orderBy("idx").limit(limit)
