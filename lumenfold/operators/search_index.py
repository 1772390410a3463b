"""A catalogue's words on disk, and many typed lines looked up in it at once.

A row is found as ``search.matching_rows`` finds it: its text holds the line as a phrase, or has all of the line's words. A phrase may begin and end
inside words. So the index has two kinds of terms: a row's words, and its seams, the letters on both sides of a space between two words. A line of several words
is looked up by the rarest of its seams, as a phrase, and by its rarest word, as a set of words, and the rows that these give are tested by their text. A line
of one word stands for every known word that has it inside; such words meet it by its rarest run of letters.

Three tables: ``words`` (word, key), words and seams, by buckets, each bucket in parts by key, so that a word which a third of the rows have isn't one task;
``rows`` (key, hay) by buckets of keys; ``known`` (word, n), how many keys have a word. A search reads only the buckets of ``words`` that
hold what its lines ask for; the driver gets their numbers. Joins are by sorted shuffles: files of words are small for their rows, so
tables that the optimizer takes for small would be large in the driver that broadcasts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import normalized
from lumenfold.operators.components import saved
from lumenfold.operators.search import haystack

#: Letters of a run within a word, and on each side of a seam, at most.
RUN = 3


def _runs(word: Column, k: Column) -> Column:
    """The runs of ``k`` letters of a word that has as many."""
    return F.transform(F.sequence(F.lit(1), F.char_length(word) - k + 1), lambda i: F.substr(word, i, k))


def _inner_runs(word: Column) -> Column:
    """Every run of a word of up to ``RUN`` letters."""
    sizes = [F.when(F.char_length(word) >= k, _runs(word, F.lit(k))) for k in range(1, RUN + 1)]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*sizes))))


def _seams(words: Column, widths: list[tuple[Column, Column]]) -> Column:
    """What stands on both sides of each space between ``words``, in these widths; widths beyond a word give nothing."""

    def around(i: Column) -> Column:
        a, b = F.get(words, i), F.get(words, i + 1)
        return F.array_compact(F.array(*[F.when((F.char_length(a) >= x) & (F.char_length(b) >= y), F.concat(F.right(a, x), F.lit(" "), F.left(b, y))) for x, y in widths]))

    return F.when(F.size(words) > 1, F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 2), around))).otherwise(F.array().cast("array<string>"))


class SearchIndex:
    """An index at ``path``; ``buckets`` of words and of keys, and ``parts`` of a bucket of words, are fixed once for it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, parts: int = 8):
        self.spark, self.path, self.buckets, self.parts = spark, path.rstrip("/"), buckets, parts

    def _bucket(self, name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.col(name)), F.lit(n)).cast("int")

    def _read(self, name: str) -> DataFrame:
        """``rows`` or ``words``, which have no files where the catalogue was empty."""
        schema = self.spark.read.parquet(f"{self.path}/schema_{name}").schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _write(self, name: str, table: DataFrame) -> None:
        table.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schema_{name}")
        table.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{name}")

    def write(self, events: DataFrame, key: str = "key") -> None:
        """Index a catalogue (key, title, lineup, venue), in place of what is there. Rows without a key or a word can't be found; where a key repeats, any of its rows finds it."""
        rows = events.select(F.col(key).alias("key"), haystack(events).alias("hay")).where("key is not null and hay <> ''").distinct()
        self._write("rows", rows.withColumn("_bucket", self._bucket("key", self.buckets)).repartition("_bucket"))
        widths = [(F.lit(x), F.lit(y)) for x in range(1, RUN + 1) for y in range(1, RUN + 1)]
        split = rows.select("key", F.split("hay", " ").alias("_w"))
        words = split.select("key", F.explode(F.array_distinct(F.concat("_w", _seams(F.col("_w"), widths)))).alias("word")).distinct()
        words = words.withColumns({"_bucket": self._bucket("word", self.buckets), "_part": self._bucket("key", self.parts)})
        self._write("words", words.repartition("_bucket", "_part"))
        told = self._read("words").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        told.write.mode("overwrite").parquet(f"{self.path}/known")

    def asked(self, phrases: DataFrame) -> DataFrame:
        """(phrase, size, word): the known words and seams by which each phrase is looked up."""
        known = self.spark.read.parquet(f"{self.path}/known")
        split = phrases.select("phrase", F.split("phrase", " ").alias("_w")).withColumn("size", F.size("_w"))
        # A phrase's seams are as wide as its words let them be: where an inner word is short, the row has the same word there.
        seams = F.transform(F.sequence(F.lit(0), F.col("size") - 2), lambda i: F.concat(F.right(F.get("_w", i), F.lit(RUN)), F.lit(" "), F.left(F.get("_w", i + 1), F.lit(RUN))))
        ways = F.array(F.struct(F.lit("phrase").alias("way"), seams.alias("terms")), F.struct(F.lit("words").alias("way"), F.array_distinct("_w").alias("terms")))
        terms = split.where("size > 1").select("phrase", "size", F.inline(ways)).select("phrase", "size", "way", F.explode("terms").alias("word"))
        rated = terms.join(known.hint("merge"), "word", "left").groupBy("phrase", "size", "way")
        several = rated.agg(F.min_by("word", F.struct("n", "word")).alias("word"), F.count_if(F.col("n").isNull()).alias("_none")).where("_none = 0").select("phrase", "size", "word")
        runs = known.where(~F.contains("word", F.lit(" "))).select("word", F.explode(_inner_runs(F.col("word"))).alias("run"))
        counts = runs.groupBy("run").agg(F.count(F.lit(1)).alias("c"))
        letters = _runs(F.col("phrase"), F.least(F.char_length("phrase"), F.lit(RUN)))
        single = split.where("size = 1").select("phrase", "size", F.explode(letters).alias("run")).join(counts.hint("merge"), "run", "left")
        rarest = single.groupBy("phrase", "size").agg(F.min_by("run", F.struct(F.coalesce("c", F.lit(0)), "run")).alias("run"))
        return several.distinct().unionByName(rarest.join(runs.hint("merge"), "run").where(F.contains("word", "phrase")).select("phrase", "size", "word"))

    def postings(self, words: DataFrame) -> DataFrame:
        """``words`` of the index, of the buckets that hold any of these."""
        some = [r[0] for r in words.select(self._bucket("word", self.buckets)).distinct().collect()]  # as many as buckets at most
        return self._read("words").where(F.col("_bucket").isin(some)).drop("_bucket")

    def search(self, lines: DataFrame) -> DataFrame:
        """(line, key): which rows each typed line finds, each pair once; ``lines``: line. Null lines and those without a letter or digit find nothing."""
        typed = lines.select("line", normalized("line").alias("phrase")).where("phrase <> ''").distinct()
        asked = saved(self.asked(typed.select("phrase").distinct()))
        spread = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
        met = spread.join(self.postings(asked).hint("merge"), ["word", "_part"]).select("phrase", "size", "key").distinct()
        rows = self._read("rows").drop("_bucket")
        every = F.size(F.array_except(F.split("phrase", " "), F.split("hay", " "))) == 0
        several = met.where("size > 1").join(rows.hint("merge"), "key").where(F.contains("hay", "phrase") | every).select("phrase", "key")
        found = met.where("size = 1").select("phrase", "key").unionByName(several.distinct())
        return found.join(typed.hint("merge"), "phrase").select("line", "key")
