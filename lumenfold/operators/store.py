"""Keyed tables in versions: rows in buckets by the hash of their key, and a manifest that tells which folder each bucket of a version is in.

A merge reads and writes only the buckets that its batch has keys of; all others stay in the folders of earlier versions. A manifest is
written last, so a version is there as a whole or not at all, and a run that was stopped can be run again. It has a digest of each bucket, so two
versions are compared by reading only the buckets that differ. The driver sees a manifest: as many rows as a store has buckets. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import artist_key
from lumenfold.operators import maintain
from lumenfold.operators.dedupe import first_of

#: A merge's rule: (rows of the store that may change, the batch) -> what these rows become.
Fold = Callable[[DataFrame, DataFrame], DataFrame]


class Store:
    """A table at ``path`` by ``key`` in ``buckets`` buckets, a number that is fixed once for a store."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _file(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def versions(self) -> list[int]:
        """The published versions, ascending."""
        fs, p = self._file(f"{self.path}/manifests")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if fs.exists(self._file(f"{s.getPath()}/_SUCCESS")[1]))

    def manifest(self, version: int) -> dict[int, tuple[int, int, str]]:
        """By bucket the version whose folder it is in, its rows and its digest."""
        rows = self.spark.read.parquet(f"{self.path}/manifests/{version}").collect()
        return {r.bucket: (r.folder, r.n, r.digest) for r in rows}

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, version: int, kept: dict[int, tuple[int, int, str]], touched: set[int]) -> None:
        folder = f"{self.path}/data/{version}"
        rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schemas/{version}")
        self._bucketed(rows).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        written = self._of_folder(folder, rows)
        row = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
        parts = [F.sum(F.conv(F.substring(row, 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
        digests = written.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", *parts), 256).alias("digest"))
        new = [(r._bucket, version, r.n, r.digest) for r in digests.collect()]  # a row a bucket
        old = [(b, *told) for b, told in kept.items() if b not in touched]
        table = self.spark.createDataFrame(new + old, "bucket int, folder int, n long, digest string")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{version}")

    def _of_folder(self, folder: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in like.schema.fields if f.name != '_bucket')}, _bucket int").parquet(folder)

    def publish(self, rows: DataFrame, version: int) -> None:
        """Make ``rows`` a version; nothing happens where it is published already."""
        if version not in self.versions():
            self._write(rows, version, {}, set())

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A version's rows (the latest), of some buckets alone."""
        version = self.versions()[-1] if version is None else version
        found = {b: told for b, told in self.manifest(version).items() if buckets is None or b in buckets}
        like, out = self.spark.read.parquet(f"{self.path}/schemas/{version}"), None
        for folder in sorted({f for f, _, _ in found.values()}):
            some = [b for b, (f, _, _) in found.items() if f == folder]
            rows = self._of_folder(f"{self.path}/data/{folder}", like).where(F.col("_bucket").isin(some)).drop("_bucket")
            out = rows if out is None else out.unionByName(rows)
        return like if out is None else out

    def merge(self, batch: DataFrame, version: int, fold: Fold) -> None:
        """Publish the latest version with ``batch`` folded in; only buckets that the batch has keys of are read and written."""
        before = self.versions()
        if version in before:
            return
        last = max(v for v in before if v < version)
        touched = {r[0] for r in self._bucketed(batch).select("_bucket").distinct().collect()}  # as many as buckets at most
        if touched:
            self._write(fold(self.read(last, touched), batch), version, self.manifest(last), touched)
        else:
            self._write(self.read(last, set()), version, self.manifest(last), set())

    def differing(self, old: int, new: int) -> set[int]:
        """The buckets whose rows differ between two versions."""
        a, b = self.manifest(old), self.manifest(new)
        return {k for k in a.keys() | b.keys() if a.get(k, (0, 0, ""))[1:] != b.get(k, (0, 0, ""))[1:]}

    def changes(self, old: int, new: int) -> DataFrame:
        """(key, change): keys that were "added", "removed" or "changed" between two versions with a row a key; buckets that are alike aren't read."""
        some = self.differing(old, new)
        rows = lambda v, name: self.read(v, some).select(self.key, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))
        both = rows(old, "_old").join(rows(new, "_new"), self.key, "full")
        change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
        return both.select(self.key, change.alias("change")).where("change is not null")


def last_wins(by: str, order: str) -> Fold:
    """The batch over the store, its last row by ``order``."""
    return lambda old, batch: maintain.upsert(old, batch, [by], order)


def first_stays(by: str, order: str) -> Fold:
    """A write-once store: what is there stays; of a batch the first row by ``order``."""

    def fold(old: DataFrame, batch: DataFrame) -> DataFrame:
        new = first_of(batch, [by], F.asc(order)).join(old.select(by), by, "left_anti")
        return old.unionByName(new, allowMissingColumns=True)

    return fold


def enriched(results: DataFrame, now: str) -> DataFrame:
    """Results (id, card: draw, rarity, lineup_depth) as records of a cache: stamped, full unless they say otherwise, cards within bounds; without an id they go."""
    kind = results.schema["card"].dataType
    clamp = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(F.col(f"card.{c}").cast("string").try_cast("int"), F.lit(0)))).cast(kind[c].dataType)
    bounds = {"draw": 3, "rarity": 2, "lineup_depth": 2}
    card = F.when(F.col("card").isNotNull(), F.struct(*[(clamp(c, bounds[c]) if c in bounds else F.col(f"card.{c}")).alias(c) for c in kind.names]))
    tier = F.coalesce(F.nullif("enriched_tier", F.lit("")), F.lit("full")) if "enriched_tier" in results.columns else F.lit("full")
    return results.where("id <> ''").withColumns({"card": card, "enriched_tier": tier, "enriched_at": F.lit(now)})


def artist_notes(results: DataFrame, now: str) -> DataFrame:
    """(name, note, seen, ord): what results (ord, artist_notes: name, note) say of artists, by comparable name, for a store where the first note stays."""
    one = results.select("ord", F.posexplode("artist_notes").alias("_i", "_n"))
    return one.select(artist_key("_n.name").alias("name"), F.col("_n.note").alias("note"), F.lit(now).alias("seen"), F.struct("ord", "_i").alias("ord")).where("name <> ''")


def judged(raw: DataFrame, lanes: tuple[str, ...], now: str, input_version: int, scores: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """Valid verdicts (id, tier, adjust, lane, why, confidence) with their stamps; ``scores`` (id, score) tell the score at judging, or else a verdict's own ``score``."""
    good = maintain.valid_verdicts(raw.where("id <> ''"), lanes).withColumns({"judged_at": F.lit(now), "input_version": F.lit(input_version), "model": F.lit(model).cast("string")})
    own = F.col("score") if "score" in raw.columns else F.lit(None).cast("double")
    if scores is None:
        return good.withColumn("score_at_judge", own).drop("score")
    known = scores.groupBy(F.col("id").alias("_id")).agg(F.max("score").alias("_score"))
    return good.join(known, good["id"] == F.col("_id"), "left").withColumn("score_at_judge", F.coalesce("_score", own)).drop("_id", "_score", "score")


def wanted_names(catalog: DataFrame, notes: DataFrame, today: str, categories: tuple[str, ...]) -> DataFrame:
    """(key, name): every artist worth a link: of upcoming bills (date, category, lineup, ord) of musical categories, then of notes (name, ord); the first spelling of each."""
    coming = catalog.where((F.coalesce("date", F.lit("")) >= today) & F.lower(F.coalesce("category", F.lit(""))).isin(*categories))
    said = coming.select(F.struct(F.lit(0).alias("k"), F.col("ord").cast("long").alias("o"), F.lit(0).alias("i")).alias("turn"), F.posexplode("lineup").alias("i", "name"))
    said = said.select(F.struct("turn.k", "turn.o", "i").alias("turn"), F.trim("name").alias("name"))
    told = notes.select(F.struct(F.lit(1).alias("k"), F.col("ord").cast("long").alias("o"), F.lit(0).alias("i")).alias("turn"), F.trim("name").alias("name"))
    both = said.union(told).withColumn("key", artist_key("name")).where("key <> ''")
    return both.groupBy("key").agg(F.min_by("name", "turn").alias("name"))
