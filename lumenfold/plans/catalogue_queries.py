"""Queries over the catalogue of listings: scoring, selection, series, quality and maintenance."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.config import Taste
from lumenfold.functions import dates, prices
from lumenfold.functions.text import event_key, normalized, sql_event_key, sql_norm, venue_key
from lumenfold.operators import dedupe, maintain, matching, places, quality, score, select, series, tags
from lumenfold.operators.components import connected_components, dealt, new_folder, partitions, sides
from lumenfold.operators.store import Store, last_wins
from lumenfold.plans.registry import query
from lumenfold.plans.views import LISTING, SQL_TODAY, TODAY, listing, table

TASTE = Taste(
    category_weights={"electronic": 3, "film": 2, "music": 2, "market": 1, "comedy": 1, "general": 1}, near_home=("nation_3", "nation_7", "nation_11"),
    groove=("ring", "hot"), penalty=("bolt", "cold"), far=("nation_20", "nation_21"), thresholds=((5, 5), (4, 4), (3, 3), (2, 2)),
)
GAZETTEER = tags.Gazetteer(
    scale={"supplier#00000000": "bar", "supplier#000000001": "arena", "supplier#0000000": "room", "supplier#000000004": "hall"},
    regions={"east": ("nation_1", "nation_2", "nation_3"), "west": ("nation_3", "nation_4", "nation_5")}, near_home=("nation_3", "nation_7", "nation_11"),
)
SCORED = f"""{LISTING}, scored AS (SELECT *, CASE WHEN score >= 5 THEN 5 WHEN score >= 4 THEN 4 WHEN score >= 3 THEN 3 WHEN score >= 2 THEN 2 ELSE 1 END::BIGINT AS rating FROM (
  SELECT *, (CASE category WHEN 'electronic' THEN 3 WHEN 'film' THEN 2 WHEN 'music' THEN 2 WHEN 'comedy' THEN -1 ELSE 1 END
    + CASE WHEN title LIKE '%ring%' OR title LIKE '%hot%' THEN 1 ELSE 0 END + CASE WHEN isodow(day) IN (5, 6) THEN 1 ELSE 0 END
    + CASE WHEN lower(neighborhood) IN ('nation_3', 'nation_7', 'nation_11') THEN 1 ELSE 0 END
    - CASE WHEN title LIKE '%bolt%' THEN 2 ELSE 0 END - CASE WHEN title LIKE '%cold%' THEN 2 ELSE 0 END
    - CASE WHEN lower(neighborhood) LIKE '%nation_20%' OR lower(neighborhood) LIKE '%nation_21%' THEN 2 ELSE 0 END)::BIGINT AS score FROM listing))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.scored(listing(spark, sf_dir), TASTE)


@query(f"""WITH {SCORED}, open AS (SELECT * FROM scored WHERE day BETWEEN {SQL_TODAY} AND {SQL_TODAY} + 60 AND rating >= 3),
best AS (SELECT * FROM open QUALIFY row_number() OVER (PARTITION BY day ORDER BY rating DESC, score DESC, title, id) <= 3)
SELECT day, id, title, venue, start, rating, score FROM best ORDER BY rating DESC, score DESC, title, id LIMIT 500""")
def calendar_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = select.calendar(scored(spark, sf_dir), select.Selection(least_rating=3, per_day=3, horizon=60), TODAY)
    return picked.select("day", "id", "title", "venue", "start", "rating", "score")


@query(f"WITH {LISTING} SELECT id, {sql_norm('title')} AS title_key, {sql_norm('venue')} AS venue_name, {sql_event_key('title', 'day', 'venue')} AS key FROM listing")
def event_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("id", normalized("title").alias("title_key"), venue_key("venue").alias("venue_name"), event_key("title", "day", "venue").alias("key"))


@query(f"""WITH {LISTING}, range AS (SELECT id, floor(amount)::BIGINT AS low, floor(amount * (1 + (id % 2) * 0.1))::BIGINT AS high FROM listing)
SELECT id, CASE WHEN low = high THEN '$' || low ELSE '$' || low || '-$' || high END AS price, low::DOUBLE AS least, high::BIGINT AS most FROM range""")
def price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.floor("amount"), F.floor(F.col("amount") * (1 + (F.col("id") % 2) * F.lit(0.1)))
    made = listing(spark, sf_dir).select("id", F.replace(prices.price_text(F.lit(None).cast("string"), low, high), F.lit("-"), F.lit("-$")).alias("price"))
    return made.select("id", "price", prices.least_amount("price").alias("least"), prices.most_whole_amount("price").alias("most"))


@query(f"WITH {LISTING} SELECT id, day FROM listing WHERE day >= {SQL_TODAY}")
def expire_past(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.expire_past(listing(spark, sf_dir), TODAY).select("id", "day")


@query(f"WITH {LISTING} SELECT id, neighborhood FROM listing WHERE lower(neighborhood) NOT IN ('nation_20', 'nation_21', 'nation_22') OR lower(venue) LIKE '%0000000%5%' AND lower(venue) LIKE '%supplier#000000005%'")
def out_of_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = quality.worth_a_trip("title", "venue", F.lit(False), ("supplier#000000005",))
    return quality.drop_out_of_market(listing(spark, sf_dir), ("nation_20", "nation_21", "nation_22"), keep).select("id", "neighborhood")


@query(f"WITH {SCORED} SELECT id, day, score, rating FROM scored WHERE day BETWEEN {SQL_TODAY} AND {SQL_TODAY} + 28 AND line <> 'F'")
def score_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    unlisted = scored(spark, sf_dir).withColumn("status", F.when(F.col("line") == "F", "unlisted"))
    return quality.in_window(unlisted, TODAY, 28).select("id", "day", "score", "rating")


@query(f"WITH {SCORED} SELECT score, rating, count(*) AS n, min(id) AS first, max(id) AS last FROM scored GROUP BY score, rating")
def score_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("score", "rating").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


TAGGED = f"""{LISTING}, tagged AS (SELECT *, split_part(start, ':', 1)::BIGINT AS hour,
  CASE category WHEN 'film' THEN 'film' WHEN 'electronic' THEN 'club' WHEN 'comedy' THEN 'comedy' WHEN 'music' THEN 'live-music' WHEN 'market' THEN 'market' ELSE 'other' END AS type,
  CASE WHEN lower(venue) LIKE '%supplier#000000001%' THEN 'arena' WHEN lower(venue) LIKE '%supplier#000000004%' THEN 'hall' WHEN lower(venue) LIKE '%supplier#00000000%' THEN 'bar' WHEN lower(venue) LIKE '%supplier#0000000%' THEN 'room' END AS scale,
  CASE WHEN lower(neighborhood) IN ('nation_1', 'nation_2', 'nation_3') THEN 'east' WHEN lower(neighborhood) IN ('nation_4', 'nation_5') THEN 'west' END AS region,
  lower(neighborhood) IN ('nation_3', 'nation_7', 'nation_11') AS near_home FROM listing)"""


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.tagged(listing(spark, sf_dir), GAZETTEER)


@query(f"WITH {TAGGED} SELECT id, type, scale, region, near_home FROM tagged")
def tag_type_scale_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("id", "type", "scale", "region", "near_home")


@query(f"""WITH {TAGGED} SELECT id, concat_ws(',', CASE WHEN type = 'club' AND hour < 9 THEN 'afterhours' END, CASE WHEN type = 'club' AND hour BETWEEN 11 AND 16 THEN 'day-party' END,
  CASE WHEN type = 'film' AND hour >= 9 AND hour < 17 THEN 'matinee' END) AS vibe, CASE WHEN type = 'club' THEN 'electronic' ELSE '' END AS genre FROM tagged""")
def tag_vibe_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("id", F.array_join("vibe", ",").alias("vibe"), F.array_join("genres", ",").alias("genre"))


LANES = f"""{TAGGED}, laned AS (SELECT *, CASE WHEN type = 'club' THEN CASE WHEN hour < 9 THEN 'club:afters' WHEN hour BETWEEN 11 AND 16 THEN 'club:day' WHEN scale IN ('arena', 'hall') THEN 'club:mainstream' ELSE 'club:underground' END
  WHEN type = 'live-music' AND scale IN ('arena', 'hall') THEN 'live-music:big' ELSE type END AS lane FROM tagged)"""


def laned(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Tagged listings, or ``rows`` that are listings, with their lane."""
    t = tags.tagged(listing(spark, sf_dir) if rows is None else rows, GAZETTEER, score.LANE_FLAGS).withColumn("price", F.lit(None).cast("string"))
    return t.withColumn("lane", tags.once(score.lane(t)))


@query(f"WITH {LANES} SELECT lane, count(*) AS n, min(id) AS first FROM laned GROUP BY lane")
def lane_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laned(spark, sf_dir).groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query(f"""WITH {TAGGED} SELECT 'type' AS axis, type AS value, count(*) AS n FROM tagged GROUP BY ALL UNION ALL SELECT 'scale', scale, count(*) FROM tagged WHERE scale IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'vibe', v, count(*) FROM (SELECT CASE WHEN type = 'club' AND hour < 9 THEN 'afterhours' WHEN type = 'club' AND hour BETWEEN 11 AND 16 THEN 'day-party' WHEN type = 'film' AND hour >= 9 AND hour < 17 THEN 'matinee' END AS v FROM tagged) WHERE v IS NOT NULL GROUP BY ALL""")
def tag_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.facets(tagged(spark, sf_dir), ("type", "scale", "vibe"))


VERDICTS = """verdicts AS (SELECT p_partkey AS part, CASE p_size % 5 WHEN 0 THEN 'must-see' WHEN 1 THEN 'great' WHEN 2 THEN 'solid' WHEN 3 THEN 'skip' END AS tier, p_size % 7 - 3 AS adjust FROM part WHERE p_size % 5 <> 4),
ranked AS (SELECT s.*, v.tier, v.adjust, (s.score + coalesce(v.adjust, 0) + CASE v.tier WHEN 'must-see' THEN 3 WHEN 'great' THEN 2 WHEN 'solid' THEN 1 WHEN 'skip' THEN -5 ELSE 0 END)::BIGINT AS rank_score FROM scored s LEFT JOIN verdicts v USING (part))"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored listings with the verdict on their part, which are as many as parts and join by it."""
    part = table(spark, sf_dir, "part")
    tier = F.element_at(F.array(*map(F.lit, ("must-see", "great", "solid", "skip"))), F.col("p_size") % 5 + 1)
    rows, part = sides(scored(spark, sf_dir), "part", part, "p_partkey", partitions(table(spark, sf_dir, "lineitem")))
    verdicts = part.where("p_size % 5 <> 4").select(F.col("p_partkey").alias("part"), tier.alias("tier"), (F.col("p_size") % 7 - 3).alias("adjust"))
    both = rows.join(verdicts, "part", "left")
    return both.withColumn("rank_score", score.rank_score(F.col("score"), F.col("adjust"), F.col("tier")))


@query(f"WITH {SCORED}, {VERDICTS} SELECT id, score, tier, adjust::BIGINT AS adjust, rank_score FROM ranked")
def rank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("id", "score", "tier", "adjust", "rank_score")


@query(f"WITH {SCORED}, {VERDICTS} SELECT id, day, rank_score FROM ranked WHERE day >= {SQL_TODAY} ORDER BY rank_score DESC, day, id LIMIT 40")
def head_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.top(quality.expire_past(ranked(spark, sf_dir), TODAY), 40, F.desc("rank_score"), F.asc("day"), F.asc("id")).select("id", "day", "rank_score")


@query(f"""WITH {SCORED}, t AS (SELECT * FROM scored WHERE day BETWEEN {SQL_TODAY} AND {SQL_TODAY} + 28),
head AS (SELECT id, score FROM t WHERE category <> 'market' ORDER BY score DESC, day, id LIMIT 120)
SELECT id, score FROM head UNION ALL SELECT id, score FROM t WHERE category = 'market' AND score >= 2""")
def judge_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = quality.in_window(scored(spark, sf_dir).withColumns({"status": F.lit(""), "lane": F.col("category")}), TODAY, 28)
    return select.judge_pool(t, 120, 2, ("market",)).select("id", "score")


@query(f"""WITH {SCORED}, cached AS (SELECT DISTINCT part FROM listing WHERE day < {SQL_TODAY} - 900)
SELECT id, part FROM scored WHERE day BETWEEN {SQL_TODAY} AND {SQL_TODAY} + 28 AND part NOT IN (SELECT part FROM cached)""")
def blurb_pool_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_rows = scored(spark, sf_dir)
    cached = listing(spark, sf_dir).where(F.col("day") < F.lit(TODAY - timedelta(days=900))).select("part").distinct()
    return maintain.needing(quality.in_window(all_rows.withColumn("status", F.lit("")), TODAY, 28), cached, "part").select("id", "part")


@query(f"WITH {LISTING}, live AS (SELECT DISTINCT part FROM listing WHERE day >= {SQL_TODAY} + 1000) SELECT p_partkey AS part, p_name AS name FROM part WHERE p_partkey IN (SELECT part FROM live)")
def cache_prune_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = listing(spark, sf_dir).where(F.col("day") >= F.lit(TODAY + timedelta(days=1000)))
    store = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"))
    return maintain.pruned(store, live, "part")


SERIES = f"runs AS (SELECT *, 'run:' || {sql_norm('title')} || '|' || {sql_norm('venue')} AS series FROM listing)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).withColumn("series", series.series_key("title", "venue", F.lit(False)))


@query(f"WITH {LISTING}, {SERIES} SELECT series, count(*) AS n, min(day) AS first, max(day) AS last FROM runs GROUP BY series HAVING count(*) >= 2")
def series_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.groups(runs(spark, sf_dir)).select("series", "n", "first", "last")


@query(f"WITH {LISTING}, {SERIES} SELECT id, series, row_number() OVER (PARTITION BY series ORDER BY day, id) AS night, count(*) OVER (PARTITION BY series) AS nights FROM runs")
def night_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.night_of_n(runs(spark, sf_dir)).select("id", "series", "night", "nights")


@query(f"""WITH {LISTING}, {SERIES}, g AS (SELECT series, count(*) AS n, min(day) AS first, max(day) AS last FROM runs GROUP BY series HAVING count(*) >= 2)
SELECT series, n, last - first AS span, (last - first >= 14 AND n >= 3 AND n >= (last - first) / 7.0) AS standing FROM g""")
def standing_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = series.groups(runs(spark, sf_dir))
    return g.select("series", "n", F.datediff("last", "first").alias("span"), series.standing(F.col("first"), F.col("last"), F.col("n")).alias("standing"))


_KEYED = f"keyed AS (SELECT DISTINCT title, venue, day, {sql_event_key('title', 'day', 'venue')} AS key, max(score) OVER (PARTITION BY title, venue, day) AS rank_score, {sql_norm('title')} || '|' || {sql_norm('venue')} AS series FROM scored)"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = scored(spark, sf_dir).groupBy("title", "venue", "day").agg(F.max("score").cast("long").alias("rank_score"))
    return one.withColumns({"key": event_key("title", "day", "venue"), "series": F.concat_ws("|", normalized("title"), normalized("venue"))})


@query(f"""WITH {SCORED}, {_KEYED}, best AS (SELECT series, max_by(key, rank_score * 1000000 + r) AS key, max(rank_score) AS rank_score FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY rank_score, key) AS r FROM keyed) GROUP BY series)
SELECT k.key, k.series, row_number_of.final_rank, k.key = row_number_of.key AS series_rep FROM keyed k JOIN (SELECT *, row_number() OVER (ORDER BY rank_score DESC, key DESC) AS final_rank FROM best) row_number_of USING (series)""")
def series_rep_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.representatives(keyed(spark, sf_dir)).select("key", "series", "final_rank", "series_rep")


@query(f"WITH {SCORED}, {_KEYED} SELECT key, rank_score, row_number() OVER (ORDER BY rank_score DESC, key DESC) AS final_rank FROM keyed")
def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.global_rank(keyed(spark, sf_dir).select("key", "rank_score"), "rank_score", "key")


@query(f"""WITH {LISTING}, flags AS (SELECT id, day, source, last_seen, CASE WHEN source <> '5-LOW' AND day BETWEEN {SQL_TODAY} AND {SQL_TODAY} + 120 AND {SQL_TODAY} - last_seen >= 2 THEN 'unlisted'
  WHEN source <> '5-LOW' AND day BETWEEN {SQL_TODAY} AND {SQL_TODAY} + 120 AND line = 'F' THEN NULL ELSE CASE WHEN line = 'F' THEN 'unlisted' END END AS status FROM listing) SELECT id, status FROM flags""")
def ghost_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(spark, sf_dir).withColumns({"sources": F.array("source"), "status": F.when(F.col("line") == "F", "unlisted")})
    fetched = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("source")).distinct()
    return quality.flag_ghosts(rows, fetched, TODAY, 120).select("id", "status")


_FRESH = f"fresh AS (SELECT source, count(*) AS n, max(last_seen) AS newest, DATE '1970-01-01' + quantile_disc(last_seen - DATE '1970-01-01', 0.5)::INTEGER AS median_seen FROM listing GROUP BY source), freshness AS (SELECT *, {SQL_TODAY} - median_seen AS days, {SQL_TODAY} - newest AS newest_days FROM fresh)"


@query(f"WITH {LISTING}, {_FRESH} SELECT source, n, newest, median_seen, days, newest_days FROM freshness")
def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.source_freshness(listing(spark, sf_dir).withColumn("sources", F.array("source")), TODAY)


@query(f"WITH {LISTING}, {_FRESH} SELECT source, days, n FROM freshness WHERE days >= -30 AND n >= 20")
def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = quality.source_freshness(listing(spark, sf_dir).withColumn("sources", F.array("source")), TODAY)
    return quality.stale_sources(fresh, -30, 20).select("source", "days", "n")


@query(f"""WITH {LISTING}, h AS (SELECT sha256(venue || '|' || day || '|' || title) AS h FROM listing),
s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT) AS s0, sum(('0x' || substr(h, 16, 15))::BIGINT) AS s1, sum(('0x' || substr(h, 31, 15))::BIGINT) AS s2, sum(('0x' || substr(h, 46, 15))::BIGINT) AS s3 FROM h)
SELECT substr(sha256(concat_ws('|', n, s0, s1, s2, s3)), 1, 12) AS version, n FROM s""")
def catalog_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.version(listing(spark, sf_dir), F.col("venue"), F.col("day"), F.col("title"))


@query(f"""WITH {LISTING}, old AS (SELECT id, floor(amount)::BIGINT::VARCHAR AS price, start, line AS status FROM listing WHERE ord % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_seen DESC, amount DESC, line DESC) = 1),
new AS (SELECT id, CASE WHEN part % 7 = 0 THEN 'x' ELSE floor(amount)::BIGINT::VARCHAR END AS price, CASE WHEN supp % 5 = 0 THEN '00:00' ELSE start END AS start, line AS status FROM listing)
SELECT n.id, o.id IS NULL AS added, CASE WHEN o.id IS NOT NULL THEN nullif(concat_ws(',', CASE WHEN n.price <> o.price THEN 'price' END, CASE WHEN n.start <> o.start THEN 'start' END, CASE WHEN n.status <> o.status THEN 'status' END), '') END AS changed FROM new n LEFT JOIN old o USING (id)""")
def catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = listing(spark, sf_dir).select("id", F.floor("amount").cast("string").alias("price"), "start", F.col("line").alias("status"), "ord", "part", "supp", "last_seen", "amount")
    new = base.withColumns({"price": F.when(F.col("part") % 7 == 0, "x").otherwise(F.col("price")), "start": F.when(F.col("supp") % 5 == 0, "00:00").otherwise(F.col("start"))})
    diff = maintain.diff_catalog(base.where("ord % 10 <> 0"), new, TODAY, "id", ("last_seen", "amount", "status"))
    return diff.select("id", "added", F.array_join("changed_fields", ",").alias("changed"))


@query(f"WITH {LISTING} SELECT id, day, date_trunc('week', day)::DATE + 4 AS friday, strftime(day, '%a ') || month(day) || '/' || day(day) AS label FROM listing")
def weekend_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("id", "day", dates.weekend_anchor("day").alias("friday"), dates.day_label("day").alias("label"))


_PLACES = places.Map(
    places={f"nation {i}": (30.0 + i, -120.0 + 2 * i) for i in range(25)}, venues={"supplier 000000003": "nation 1", "supplier 00000001": "nation 2"}, city_names=("nation 4", "nation 9"), city="The City",
    display={"nation 7": "Seven"},
)


@query("""SELECT s_suppkey AS supp, CASE WHEN s_nationkey % 5 <> 0 AND s_nationkey NOT IN (4, 9) THEN CASE WHEN s_nationkey = 7 THEN 'Seven' ELSE 'Nation ' || s_nationkey END
  WHEN s_name LIKE '%000000003%' THEN 'Nation 1' WHEN s_name LIKE '%Supplier#00000001%' THEN 'Nation 2' WHEN s_nationkey IN (4, 9) THEN 'The City' END AS place FROM supplier""")
def canonical_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("venue", F.replace("s_name", F.lit("#"), F.lit(" ")))
    own = F.when(F.col("s_nationkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("NATION "), F.col("s_nationkey").cast("string")))
    return s.select(F.col("s_suppkey").alias("supp"), places.canonical_place("venue", own, _PLACES).alias("place"))


_LEGS = f"""stops AS (SELECT ord, id, 30.0 + nation / 100.0 AS lat, -120.0 + nation / 50.0 AS lon FROM listing),
ahead AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(id) OVER w AS nxt FROM stops WINDOW w AS (PARTITION BY ord ORDER BY id)),
miles AS (SELECT ord, id, round_even(asin(sqrt(pow(sin((radians(lat2) - radians(lat)) / 2), 2.0) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2.0))) * (2 * 3958.8), 1) AS miles FROM ahead WHERE nxt IS NOT NULL),
legs AS (SELECT *, CASE WHEN miles <= 0.7 THEN 'walk' ELSE 'drive' END AS mode, CASE WHEN miles <= 0.7 THEN round_even(greatest(miles, 0.0) * 20.0, 0)
  WHEN miles <= 0 THEN 0 ELSE round_even(greatest(8.0, 5.0 + least(miles, 5.0) * 4.0 + greatest(miles - 5.0, 0.0) * 1.8), 0) END::BIGINT AS minutes FROM miles)"""


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = listing(spark, sf_dir).select("ord", "id", (F.lit(30.0) + F.col("nation") / 100.0).alias("lat"), (F.lit(-120.0) + F.col("nation") / 50.0).alias("lon"))
    return places.legs(stops, "ord", "id")


@query(f"WITH {LISTING}, {_LEGS} SELECT ord, id, miles, mode, minutes FROM legs")
def haversine_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legs(spark, sf_dir).select("ord", "id", "leg.miles", "leg.mode", "leg.minutes")


@query(f"WITH {LISTING}, {_LEGS} SELECT ord, count(*) AS legs, sum(minutes)::BIGINT AS total_minutes FROM legs GROUP BY ord")
def route_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.route_totals(_legs(spark, sf_dir), "ord").select("ord", "legs", "total_minutes")


@query(f"""WITH RECURSIVE {LISTING}, e AS (SELECT DISTINCT ord, supp * 100000 + part AS k FROM listing), edges AS (SELECT DISTINCT a.ord AS a, b.ord AS b FROM e a JOIN e b ON a.k = b.k AND a.ord <> b.ord),
reach AS (SELECT a AS node, a AS hop FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.hop = e.a) SELECT node, min(hop) AS component FROM reach GROUP BY node""")
def link_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = listing(spark, sf_dir).select("ord", (F.col("supp") * 100_000 + F.col("part")).alias("k")).distinct()
    e = dealt(e, partitions(table(spark, sf_dir, "lineitem")), "k")
    first = e.groupBy("k").agg(F.min("ord").alias("b"))
    return connected_components(e.join(first, "k").where("ord <> b").select(F.col("ord").alias("a"), "b"))


@query(f"WITH {LISTING}, e AS (SELECT id, day, substr(venue, 10) AS v, title AS t FROM listing) SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.day = b.day AND a.v = b.v AND a.id < b.id WHERE a.t = b.t OR contains(a.t, b.t) OR contains(b.t, a.t)")
def venue_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.duplicate_pairs(listing(spark, sf_dir).withColumn("venue", F.substring("venue", 10, 99)))


@query(f"""WITH {LISTING}, g AS (SELECT part, supp, count(*) AS n, min_by(title, id) AS title, (array_agg(line ORDER BY length(line) DESC, id))[1] AS line, (array_agg(source ORDER BY length(source) DESC, id))[1] AS source FROM listing GROUP BY ALL)
SELECT part, supp, title, line, source, n FROM g""")
def merge_richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.richest(listing(spark, sf_dir), ["part", "supp"], ["title", "line", "source"], "id")


@query(f"""WITH {LISTING}, s AS (SELECT c_mktsegment AS person, part AS key, (sum(quantity) % 17)::BIGINT - 5 AS score FROM listing JOIN customer ON cust = c_custkey GROUP BY ALL)
SELECT key, count(*) AS people, round_even(avg(score), 2) AS mean, min(score) AS least, max(score) AS most, count(*) FILTER (score > 0) AS n_into, count(*) FILTER (score < 0) AS n_veto FROM s GROUP BY key""")
def group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = sides(listing(spark, sf_dir), "cust", table(spark, sf_dir, "customer"), "c_custkey", partitions(table(spark, sf_dir, "lineitem")))
    joined = rows.join(c, F.col("cust") == F.col("c_custkey"))
    s = joined.groupBy(F.col("c_mktsegment").alias("person"), F.col("part").alias("key")).agg(((F.sum("quantity") % 17).cast("long") - 5).alias("score")).withColumn("rating", F.lit(1))
    return matching.group_matrix(s).withColumn("people", F.size("people"))


@query("""WITH who AS (SELECT client_id, max(nation_id) AS person FROM clients GROUP BY client_id), l AS (SELECT DISTINCT sale_id, line_no, item_id, quantity, flag FROM sale_lines WHERE item_id IS NOT NULL), s AS (SELECT sale_id, max(client_id) AS client_id FROM sales GROUP BY sale_id),
pools AS (SELECT person, item_id AS key, (sum(quantity) % 17)::BIGINT - 5 AS score, count(*) AS rating, array_to_string(list_sort(list(DISTINCT flag) FILTER (flag IS NOT NULL))[1:3], ',') AS reasons FROM l JOIN s USING (sale_id) JOIN who USING (client_id) WHERE person IS NOT NULL GROUP BY ALL),
n AS (SELECT key, round_even(avg(coalesce(score, 0)), 2) AS mean, count(*) FILTER (score > 0) AS n_into, count(*) FILTER (score < 0) AS n_veto, arg_min(person, (person % 7) * 1000 + person) AS shown FROM pools GROUP BY key)
SELECT n.key, n_nationkey::BIGINT AS person, CASE WHEN p.key IS NOT NULL THEN coalesce(score, 0) END AS score, rating, reasons, mean, n_into, n_veto, shown || '/' || n.key AS title FROM n CROSS JOIN nation LEFT JOIN pools p ON p.key = n.key AND p.person = n_nationkey""")
def group_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as members, and items that their clients bought as pools: every member's cell of every item, empty ones too."""
    who = table(spark, sf_dir, "clients").groupBy("client_id").agg(F.max("nation_id").alias("person")).where("person is not null")
    lines = table(spark, sf_dir, "sale_lines").where("item_id is not null").select("sale_id", "line_no", "item_id", "quantity", "flag").distinct()
    sales = table(spark, sf_dir, "sales").groupBy("sale_id").agg(F.max("client_id").alias("client_id"))
    pools = lines.join(sales, "sale_id").join(who, "client_id").groupBy("person", F.col("item_id").alias("key")).agg(
        ((F.sum("quantity") % 17).cast("long") - 5).alias("score"), F.count(F.lit(1)).alias("rating"), F.array_sort(F.collect_set("flag")).alias("reasons"))
    pools = pools.withColumns({"turn": F.col("key"), "title": F.concat_ws("/", "person", "key")})
    members = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("person"), (F.col("n_nationkey") % 7 * 1000 + F.col("n_nationkey")).alias("turn"))
    cells = matching.dense_matrix(pools, members).select("key", "title", "mean", "n_into", "n_veto", F.explode("people").alias("c"))
    return cells.select("key", "c.person", "c.cell.score", "c.cell.rating", F.array_join("c.cell.reasons", ",").alias("reasons"), "mean", "n_into", "n_veto", "title")


@query(f"""WITH {LISTING}, o AS (SELECT supp AS key, source, amount AS price, last_seen::VARCHAR AS checked_at, id AS ord FROM listing), l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY key, source ORDER BY ord DESC) = 1)
SELECT key, max(checked_at) AS checked_at, string_agg(source, ',' ORDER BY price, source) AS sources, min(price) AS floor FROM l GROUP BY key""")
def offer_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = listing(spark, sf_dir).select(F.col("supp").alias("key"), "source", F.col("amount").alias("price"), F.col("last_seen").cast("string").alias("checked_at"), F.col("id").alias("ord"))
    best = maintain.price_options(o)
    return best.select("key", "checked_at", F.array_join(F.transform("options", lambda x: x["source"]), ",").alias("sources"), F.get("options", F.lit(0))["price"].alias("floor"))


@query(f"""WITH {LISTING}, e AS (SELECT ord AS key, min(day) AS day, min_by(substr(venue, 10), id) AS venue, min_by(title, id) AS name FROM listing GROUP BY ord), o AS (SELECT id AS offer, last_seen AS day, substr(venue, 10) AS venue, title AS name FROM listing WHERE line = 'O'),
m AS (SELECT key, offer, (CASE WHEN e.venue = o.venue THEN 2 ELSE 0 END + CASE WHEN list_has_all(string_split(e.name, ' '), string_split(o.name, ' ')) THEN 1 ELSE 0 END)::BIGINT AS rank FROM e JOIN o USING (day))
SELECT key, offer, rank FROM m WHERE rank > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank DESC, offer) = 1""")
def best_market_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(spark, sf_dir).withColumn("venue", F.substring("venue", 10, 99))
    e = rows.groupBy(F.col("ord").alias("key")).agg(F.min("day").alias("day"), F.min_by("venue", "id").alias("venue"), F.min_by("title", "id").alias("name"))
    o = rows.where("line = 'O'").select(F.col("id").alias("offer"), F.col("last_seen").alias("day"), "venue", F.col("title").alias("name"), F.col("id").alias("ord"))
    return matching.best_offers(e, o)


@query(f"""WITH {SCORED}, {VERDICTS}, j AS (SELECT CASE tier WHEN 'must-see' THEN 3 WHEN 'great' THEN 2 WHEN 'solid' THEN 1 ELSE -2 END AS t, score, count(*) AS n FROM ranked WHERE tier IS NOT NULL GROUP BY ALL)
SELECT sum(a.n * b.n)::BIGINT AS pairs, sum(a.n * b.n * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)::DOUBLE AS concordant FROM j a JOIN j b ON a.t > b.t""")
def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.create_map(*[F.lit(x) for x in ("must-see", 3, "great", 2, "solid", 1, "skip", -2)])
    return matching.concordance(ranked(spark, sf_dir).where("tier is not null").select(F.element_at(order, F.col("tier")).alias("tier_rank"), "score"))


@query(f"""WITH {SCORED}, {VERDICTS}, a AS (SELECT day, id FROM ranked QUALIFY row_number() OVER (PARTITION BY day ORDER BY score DESC, id) <= 5), b AS (SELECT day, id FROM ranked QUALIFY row_number() OVER (PARTITION BY day ORDER BY rank_score DESC, id) <= 5),
s AS (SELECT coalesce(a.day, b.day) AS day, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS shared, count(*) AS whole FROM a FULL JOIN b ON a.id = b.id GROUP BY ALL) SELECT day, shared, whole, shared / whole AS jaccard FROM s""")
def pick_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir)
    a = select.top_in(rows, 5, ["day"], F.desc("score"), F.asc("id")).select("day", "id", F.lit(1).alias("a"))
    b = select.top_in(rows, 5, ["day"], F.desc("rank_score"), F.asc("id")).select("day", "id", F.lit(1).alias("b"))
    both = a.join(b, ["day", "id"], "full_outer").groupBy("day").agg(F.count_if(F.expr("a is not null and b is not null")).alias("shared"), F.count(F.lit(1)).alias("whole"))
    return both.withColumn("jaccard", F.col("shared") / F.col("whole"))


@query(f"""WITH {SCORED}, r AS (SELECT id, day, score, title LIKE '%hot%' AS tracked, lower(venue) LIKE '%supplier#000000001%' AS big FROM scored WHERE day >= {SQL_TODAY} + 35),
f AS (SELECT id, day, concat_ws('|', CASE WHEN tracked THEN 'tracked:hot' END, CASE WHEN big THEN 'big-venue' END) AS signals, (CASE WHEN tracked THEN 2 ELSE 0 END + CASE WHEN big THEN 1 ELSE 0 END) + score / 10.0 AS rank FROM r WHERE tracked OR big)
SELECT id, day, signals, rank::DOUBLE AS rank FROM f ORDER BY rank DESC, day, id LIMIT 200""")
def radar_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where(F.col("day") >= F.lit(TODAY + timedelta(days=35)))
    tracked = F.filter(F.array(F.when(score.has_token(F.lower("title"), "hot"), F.lit("hot"))), lambda x: x.isNotNull())
    rows = rows.withColumn("signals", matching.radar_signals(F.lower(F.to_json(F.struct("title", "venue", "neighborhood", "category"))), F.col("venue"), tracked, ("supplier#000000001",)))
    rows = rows.where(F.size("signals") > 0).withColumn("rank", matching.radar_rank(F.col("score"), F.col("signals")))
    return select.top(rows, 200, F.desc("rank"), F.asc("day"), F.asc("id")).select("id", "day", F.array_join("signals", "|").alias("signals"), "rank")


@query(f"""WITH days AS (SELECT unnest(generate_series({SQL_TODAY}, {SQL_TODAY} + 89, INTERVAL 1 DAY))::DATE AS day), rules AS (SELECT r_name AS name, r_regionkey AS k FROM region)
SELECT name, day FROM rules, days WHERE (k < 3 AND isodow(day) = k + 5 - CASE WHEN k + 5 > 7 THEN 7 ELSE 0 END OR k >= 3 AND isodow(day) = 7 AND ceil(day(day) / 7.0) = k - 2) AND NOT (k = 1 AND month(day) = 7)""")
def recurrence_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.element_at(F.array(*map(F.lit, ("weekly:fri", "weekly:sat", "weekly:sun", "monthly:1:sun", "monthly:2:sunday"))), F.col("r_regionkey") + 1)
    months = F.when(F.col("r_regionkey") == 1, F.array(F.lit(7))).otherwise(F.array().cast("array<int>"))
    rules = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), token.alias("token"), months.alias("except_months"))
    return maintain.expand_recurring(rules, TODAY, 90).select("name", "day")


@query("""WITH r AS (SELECT s_suppkey AS supp, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS r, count(*) OVER () AS n FROM supplier), bounds AS (SELECT i, i * n // 7 AS lo, (i + 1) * n // 7 AS hi FROM range(7) t(i), (SELECT count(*) AS n FROM supplier))
SELECT supp, i + 1 AS batch FROM r JOIN bounds ON r.r >= lo AND r.r < hi""")
def batch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.batches(table(spark, sf_dir, "supplier"), 7, F.desc("s_acctbal"), F.asc("s_suppkey")).select(F.col("s_suppkey").alias("supp"), "batch")


@query(f"""WITH {LANES}, s AS (SELECT id, CASE WHEN lane = 'film' THEN 'movies' WHEN lane = 'live-music:big' THEN 'fyi' WHEN lane LIKE 'club:%' OR lane = 'live-music' THEN 'sets' ELSE 'events' END AS section, CASE WHEN day <= {SQL_TODAY} + 13 THEN 'near' ELSE 'ahead' END AS shelf FROM laned WHERE day BETWEEN {SQL_TODAY} AND {SQL_TODAY} + 60)
SELECT section, shelf, id, row_number() OVER (PARTITION BY section, shelf ORDER BY id) AS place FROM s QUALIFY place <= 40""")
def front_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = quality.in_window(listing(spark, sf_dir).withColumn("status", F.lit("")), TODAY, 60)  # before tags, which no filter passes
    rows = laned(spark, sf_dir, days).withColumns({"tier": F.lit(None).cast("string"), "span": F.lit(0), "standing": F.lit(False)})
    rows = rows.withColumns({"section": select.sections(rows), "key": F.col("id"), "final_rank": F.col("id")})
    return select.shelves(rows, TODAY).select("section", "shelf", F.col("key").alias("id"), "place")


def lane_ranked(spark: SparkSession, sf_dir: str, since: date | None = None) -> DataFrame:
    """Scored and judged listings, of days from ``since`` on, with their lane, in one pass over them."""
    rows = ranked(spark, sf_dir)
    return laned(spark, sf_dir, rows if since is None else rows.where(F.col("day") >= F.lit(since))).withColumns({"key": F.col("id").cast("string"), "series": F.lit(None).cast("string")})


_TAGS = LANES.removeprefix(LISTING).replace("FROM listing)", "FROM ranked)")
LANE_RANKED = f"{SCORED}, {VERDICTS}{_TAGS}, r AS (SELECT day, id::VARCHAR AS key, title, lane, score, adjust, tier, rank_score FROM laned)"


@query(f"""WITH {LANE_RANKED}, a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY day, key ORDER BY rank_score DESC) = 1), b AS (SELECT *, string_split(lane, ':')[1] AS family FROM a WHERE coalesce(tier, '') <> 'skip'),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY day, lane ORDER BY rank_score DESC, key DESC) <= 2), d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY day, family ORDER BY rank_score DESC, key DESC) <= 3)
SELECT day, key, row_number() OVER (PARTITION BY day ORDER BY rank_score DESC, key DESC) AS place FROM d QUALIFY place <= 6""")
def top_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.top_picks(lane_ranked(spark, sf_dir), "day")


@query(f"""WITH {LANE_RANKED}, o AS (SELECT *, CASE WHEN isodow(day) IN (5, 6) THEN 8 ELSE 6 END AS size, coalesce(score, 0) + coalesce(adjust, 0) AS plain, row_number() OVER w AS place FROM r WINDOW w AS (PARTITION BY day ORDER BY rank_score DESC, key DESC)),
e AS (SELECT *, lag(plain) OVER (PARTITION BY day ORDER BY place) - plain > 3 AS falls FROM o), m AS (SELECT *, place <= size AND NOT coalesce(bool_or(falls) OVER (PARTITION BY day ORDER BY place), false) AS taken FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY day, lane ORDER BY place) AS turn FROM m WHERE taken), days AS (SELECT day, any_value(size) - count(*) AS room, count(*) FILTER (turn > 1) AS movable FROM t GROUP BY day),
g AS (SELECT day, key, rank_score, row_number() OVER (PARTITION BY day ORDER BY list_position(['club:day', 'film', 'live-music'], lane)) AS place FROM (SELECT * FROM m WHERE lane IN ('club:day', 'film', 'live-music') AND score >= 2 AND (day, lane) NOT IN (SELECT (day, lane) FROM t) QUALIFY row_number() OVER (PARTITION BY day, lane ORDER BY m.place) = 1)),
n AS (SELECT d.*, least((SELECT count(*) FROM g WHERE g.day = d.day), room + movable) AS entering FROM days d),
k AS (SELECT g.day, g.key, g.rank_score FROM g JOIN n USING (day) WHERE place <= entering UNION ALL SELECT day, key, rank_score FROM (SELECT t.*, entering - room AS gone, row_number() OVER (PARTITION BY day, turn > 1 ORDER BY place DESC) AS back FROM t JOIN n USING (day)) WHERE turn = 1 OR back > gone)
SELECT day, key, row_number() OVER (PARTITION BY day ORDER BY rank_score DESC, key DESC) AS place FROM k""")
def slate_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.slates(lane_ranked(spark, sf_dir), 6, 8, 3, ("club:day", "film", "live-music"))


#: A catalogue of a record a customer, from orders before a day, and a batch of a record for each order since; ids tell customers.
_BATCH = "DATE '1998-06-01'"
_MERGED = f"""c AS (SELECT o_custkey AS cust, min(o_orderdate::DATE) AS day, max(o_orderdate::DATE)::VARCHAR AS seen FROM orders WHERE o_orderdate::DATE < {_BATCH} GROUP BY o_custkey),
b AS (SELECT o_custkey AS cust, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE >= {_BATCH}),
n AS (SELECT cust, min(day) AS day, count(*) AS n FROM b GROUP BY cust)"""


def batch_merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("order"), F.to_date("o_orderdate").alias("day"))
    none = lambda *names: {n: F.lit(None).cast("string") for n in names}

    def records(rows: DataFrame) -> DataFrame:
        url = F.concat(F.lit("https://ra.co/events/"), F.col("cust").cast("string"))
        made = {"title": F.md5(F.col("ord").cast("string")), "venue": F.sha1(F.col("ord").cast("string")), "lineup": F.array().cast("array<string>"), "sources": F.array(F.lit("orders")), "ra_pick": F.lit(False), "afterhours": F.lit(False)}
        links = F.array(F.struct(F.lit("site").alias("source"), url.alias("url"), F.lit(None).cast("string").alias("label")))
        return rows.withColumns(made | {"links": links} | none("start", "neighborhood", "genre", "lineup_genre", "organizers", "detail", "image", "price", "status"))

    old = orders.where("day < date'1998-06-01'").groupBy("cust").agg(F.min("day").alias("day"), F.max("day").cast("string").alias("last_seen"))
    old = records(old.withColumn("ord", F.col("cust")).withColumn("first_seen", F.col("day").cast("string")))
    new = records(orders.where("day >= date'1998-06-01'").withColumn("ord", F.col("order")).withColumns(none("first_seen", "last_seen"))).drop("order")
    return dedupe.merge_new(old, new, "1998-08-03")


@query(f"""WITH {_MERGED} SELECT coalesce(c.cust, n.cust) AS cust, coalesce(c.day, n.day) AS day, coalesce(c.day::VARCHAR, '1998-08-03') AS first_seen, CASE WHEN n.cust IS NULL THEN c.seen ELSE '1998-08-03' END AS last_seen,
(c.cust IS NOT NULL)::BIGINT + coalesce(n.n, 0) AS n FROM c FULL JOIN n ON c.cust = n.cust""")
def merge_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_merged(spark, sf_dir)[0].select("cust", "day", "first_seen", "last_seen", F.size("members").alias("n"))


@query(f"""WITH {_MERGED}, d AS (SELECT day FROM b UNION SELECT day FROM c WHERE cust IN (SELECT cust FROM b))
SELECT (SELECT count(*) FROM b) AS incoming, 0::BIGINT AS junk, (SELECT count(*) FROM d) AS days, (SELECT count(*) FROM c WHERE day IN (SELECT day FROM d)) AS read,
(SELECT count(*) FROM n WHERE cust NOT IN (SELECT cust FROM c)) AS added, (SELECT count(*) FROM b WHERE cust IN (SELECT cust FROM c)) AS joined, 0::BIGINT AS gone, (SELECT count(*) FROM (SELECT cust FROM c UNION SELECT cust FROM n)) AS total""")
def merge_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_merged(spark, sf_dir)[1]


_LATEST = f"""a AS (SELECT o_custkey AS cust, max(o_orderkey) AS ord FROM orders WHERE o_orderdate::DATE < {_BATCH} GROUP BY o_custkey), b AS (SELECT o_custkey AS cust, max(o_orderkey) AS ord FROM orders WHERE o_orderdate::DATE >= {_BATCH} GROUP BY o_custkey)"""


def latest_orders(spark: SparkSession, sf_dir: str) -> Store:
    """A store of each customer's latest order: a version from orders before a day, and one with a batch of those since merged in."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("ord"), F.to_date("o_orderdate").alias("day"))
    kept = Store(spark, new_folder(spark), "cust", 16)
    old = rows.where("day < date'1998-06-01'").groupBy("cust").agg(F.max("ord").alias("ord"))
    kept.publish(old, 1)
    kept.merge(rows.where("day >= date'1998-06-01'").drop("day"), 2, last_wins("cust", "ord"))
    return kept


@query(f"WITH {_LATEST} SELECT coalesce(b.cust, a.cust) AS cust, coalesce(b.ord, a.ord) AS ord FROM a FULL JOIN b ON a.cust = b.cust")
def store_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_orders(spark, sf_dir).read()


@query(f"WITH {_LATEST} SELECT b.cust, CASE WHEN a.cust IS NULL THEN 'added' ELSE 'changed' END AS change FROM b LEFT JOIN a ON a.cust = b.cust WHERE a.ord IS NULL OR a.ord <> b.ord")
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_orders(spark, sf_dir).changes(1, 2)


@query()
def dedupe_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of one catalogue: the busiest part's name at the first supplier's."""
    rows = listing(spark, sf_dir).groupBy("ord").agg(F.min("day").alias("day"), F.min_by("title", "id").alias("title"), F.min_by("venue", "id").alias("venue"), F.min_by("source", "id").alias("source"), F.max("last_seen").cast("string").alias("last_seen"))
    text = lambda *names: {n: F.lit(None).cast("string") for n in names}
    rows = rows.withColumns({
        "venue": F.concat(F.lit("Hall "), F.substring("venue", -2, 2)), "lineup": F.array("title"), "links": F.array(F.struct(F.lit("site").alias("source"), F.concat(F.lit("https://ra.co/events/"), (F.col("ord") * 7 % 40_000).cast("string")).alias("url"), F.lit(None).cast("string").alias("label"))),
        "sources": F.array("source"), "ra_pick": F.lit(False), "afterhours": F.lit(False), **text("start", "neighborhood", "genre", "lineup_genre", "organizers", "detail", "image", "price", "first_seen", "status"),
    }).drop("source")
    return dedupe.dedupe(rows).select("ord", "day", "title", "venue", F.size("members").alias("n"), F.array_join(F.array_sort("sources"), ",").alias("sources"))


@query()
def ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name")).distinct()
    names = names.withColumn("id", F.xxhash64("brand", "name"))
    met = dedupe.similar_pairs(names.withColumnRenamed("name", "s"), 0.8, "brand")
    a, b = (names.select("brand", F.col("id").alias(k), F.col("name").alias(f"name_{k}")) for k in "ab")
    both = met.join(a, "a").join(b.drop("brand"), "b").select("brand", F.least("name_a", "name_b").alias("name"), F.greatest("name_a", "name_b").alias("other"))
    return dedupe.ratios(both, "name", "other", 0.8)


@query(f"WITH {LISTING}, r AS (SELECT cust, max(day) AS day, count(DISTINCT day) AS n FROM listing GROUP BY cust) SELECT cust, day, n, lag(day) OVER (ORDER BY cust) IS NULL AS head FROM r")
def last_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing(spark, sf_dir).groupBy("cust").agg(F.max("day").alias("day"), F.count_distinct("day").alias("n"))
    first = rows.agg(F.min("cust").alias("least"))
    return rows.crossJoin(F.broadcast(first)).select("cust", "day", "n", (F.col("cust") == F.col("least")).alias("head"))  # one row beside


