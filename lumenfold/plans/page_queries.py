"""Queries over what is shown: the front page, digest sections and studies of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import digest, front_page, matching, select
from lumenfold.operators.components import saved
from lumenfold.plans.catalogue_queries import LANE_RANKED, SCORED, VERDICTS, laned, ranked, scored
from lumenfold.plans.registry import query
from lumenfold.plans.views import SQL_TODAY, TODAY

#: A row's section by lane and verdict, where no festival and no standing programme is.
_SECTION = "CASE WHEN lane = 'film' THEN 'movies' WHEN lane = 'live-music:big' THEN CASE WHEN tier IN ('must-see', 'great') THEN 'sets' ELSE 'fyi' END WHEN lane LIKE 'club:%' OR lane = 'live-music' THEN 'sets' ELSE 'events' END"
_POOL = f"{LANE_RANKED}, p AS (SELECT *, {_SECTION} AS section FROM r WHERE day >= {SQL_TODAY} AND score >= 0 AND coalesce(tier, '') <> 'skip')"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may stand on the page, told before lanes are looked for, as no filter passes them."""
    none = F.lit(None)
    rows = ranked(spark, sf_dir).withColumns({"series": none.cast("string"), "series_rep": F.lit(True)})
    rows = laned(spark, sf_dir, front_page.pool(rows, TODAY)).withColumns({"key": F.col("id").cast("string"), "span": F.lit(0), "standing": F.lit(False), "first": none.cast("date"), "last": none.cast("date")})
    return rows.withColumn("section", select.sections(rows))


@query(f"""WITH {_POOL}, l AS (SELECT * FROM (VALUES ('today', {SQL_TODAY}, {SQL_TODAY}), ('weekend', {SQL_TODAY} + 4, {SQL_TODAY} + 6), ('twoweeks', {SQL_TODAY}, {SQL_TODAY} + 20), ('ahead', {SQL_TODAY} + 14, {SQL_TODAY} + 60)) t(lens, lo, hi)),
s AS (SELECT l.lens, p.*, string_split(lane, ':')[1] AS family FROM p JOIN l ON day BETWEEN lo AND hi WHERE section IN ('sets', 'events')), a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lens, key ORDER BY rank_score DESC) = 1),
c AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY lens, lane ORDER BY rank_score DESC, key DESC) <= 2), d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lens, family ORDER BY rank_score DESC, key DESC) <= 3)
SELECT lens, key, row_number() OVER (PARTITION BY lens ORDER BY rank_score DESC, key DESC) AS place FROM d QUALIFY place <= 6""")
def front_heroes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return front_page.heroes(_pool(spark, sf_dir), TODAY)


@query(f"""WITH {_POOL}, f AS (SELECT *, title LIKE '%hot%' AS hot, title LIKE '%ring%' AS ring FROM p),
m AS (SELECT 'movies' AS "table", key, row_number() OVER (ORDER BY day <= {SQL_TODAY} DESC, day, key::BIGINT) AS place FROM f WHERE section = 'movies'),
y AS (SELECT 'fyi' AS "table", key, row_number() OVER (ORDER BY day, key::BIGINT) AS place FROM (SELECT * FROM f WHERE lane = 'live-music:big' AND (hot OR ring) AND day > {SQL_TODAY} + 60 QUALIFY row_number() OVER (PARTITION BY day, hot, ring ORDER BY key::BIGINT) = 1))
SELECT * FROM m WHERE place <= 40 UNION ALL SELECT * FROM y WHERE place <= 40""")
def front_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts are words of titles; all rows are on shelves, so only those past the last lens are told of."""
    rows = _pool(spark, sf_dir).withColumns({"big": F.col("lane") == "live-music:big", "final_rank": F.col("id")})
    rows = saved(rows.select("key", "day", "section", "final_rank", "title", "vibe", "first", "last", "big"))  # every table reads them
    acts = rows.select("key", F.explode(F.array_compact(F.array(*[F.when(F.col("title").contains(w), F.lit(w)) for w in ("hot", "ring")]))).alias("act"))
    return front_page.tables(rows, acts, rows.select("key"), TODAY)


@query(f"""WITH {SCORED}, c AS (SELECT *, part || '|' || supp AS program, min(day) OVER (PARTITION BY part, supp) AS earliest FROM scored WHERE day BETWEEN {SQL_TODAY} AND {SQL_TODAY} + 120),
b AS (SELECT *, date_trunc('week', earliest)::DATE + 4 AS weekend FROM c QUALIFY row_number() OVER (PARTITION BY program ORDER BY score DESC, id, amount) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY weekend ORDER BY rating DESC, score DESC, earliest, id) AS nth, greatest(0, count(*) OVER (PARTITION BY weekend) - 4) AS more FROM b)
SELECT weekend, nth AS place, more, id, rating, score FROM p WHERE nth <= 4""")
def digest_weekends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where(F.col("day").between(F.lit(TODAY), F.date_add(F.lit(TODAY), 120)))
    cands = rows.select(F.col("id").cast("string").alias("key"), "id", "day", "title", "venue", "category", "rating", "score", F.concat_ws("|", "part", "supp").alias("series"), F.lit("").alias("link"), F.col("id").alias("ord"))
    return digest.weekends(cands).select("weekend", "place", "more", "id", "rating", "score")


_JUDGED = f"{SCORED}, {VERDICTS}, j AS (SELECT id::VARCHAR AS key, tier, adjust, score, rank_score FROM ranked WHERE tier IS NOT NULL)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).where("tier is not null").select(F.col("id").cast("string").alias("key"), "tier", "adjust", "score", "rank_score")


@query(f"""WITH {_JUDGED}, o AS (SELECT count(*) OVER () AS n, row_number() OVER (ORDER BY score DESC, key DESC) AS was, row_number() OVER (ORDER BY rank_score DESC, key DESC) AS now FROM j), m AS (SELECT n, abs(was - now) / n * 100 AS move FROM o)
SELECT n, round_even(sum(move) / n, 1) AS mean_pct, round_even(list_sort(list(move))[floor(n * 0.9)::BIGINT + 1], 1) AS p90_pct, round_even(max(move), 1) AS max_pct FROM m GROUP BY n""")
def verdict_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.displacement(_judged(spark, sf_dir))


@query(f"""WITH {_JUDGED}, p AS (SELECT *, (rank() OVER (ORDER BY score) - 1) / count(*) OVER () * 100 AS p FROM j),
k AS (SELECT key, round_even(p, 0)::BIGINT AS score_pct, concat_ws(',', CASE WHEN tier IN ('must-see', 'great') AND p <= 40 THEN 'promoted_low_score' END, CASE WHEN tier = 'skip' AND p >= 75 THEN 'demoted_high_score' END, CASE WHEN abs(adjust) >= 3 THEN 'big_adjust' END) AS kinds FROM p)
SELECT * FROM k WHERE kinds <> ''""")
def verdict_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.disagreements(_judged(spark, sf_dir)).select("key", "score_pct", F.array_join("kinds", ",").alias("kinds"))
