"""Joins with a rank: the best offer for an event, people side by side, radar signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.config import RADAR_WEIGHTS
from lumenfold.functions.text import has_any, normalized, venue_key
from lumenfold.operators.components import saved
from lumenfold.operators.score import global_rank

# Words that make a festival or a city-wide occasion.
FESTIVAL_TERMS = ("festival", "fest ", "fest)", "two-day", "three-day", "2-day", "3-day", "weekender", "block party")
CIVIC_TERMS = (
    "marathon", "book fair", "book festival", "county fair", "state fair", "parade", "fireworks", "night market", "art walk", "open studios", "solstice",
    "equinox", "grand prix", "air show", "street fair", "food festival", "lantern festival", "car show", "county museum free",
)


def _long_words(c: Column, least: int) -> Column:
    return F.filter(F.split(c, " "), lambda w: F.char_length(w) >= least)


def holding_names(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """(s, os): names, as sorted sets of words, of ``longer`` (s) that have all words of a name of ``shorter`` (os).

    Every name counts once. A shorter name meets the longer ones by its rarest word, and the rest is tested.
    """
    s, os = longer.select("s").distinct(), shorter.select("os").where("size(os) > 0").distinct()
    words = s.select("s", F.explode("s").alias("w"))
    often = words.groupBy("w").agg(F.count(F.lit(1)).alias("often"))
    rarest = os.select("os", F.explode("os").alias("w")).join(often, "w").groupBy("os").agg(F.min_by("w", F.struct("often", "w")).alias("w"))
    return words.join(rarest, "w").where(F.size(F.array_except("os", "s")) == 0).select("s", "os")


def best_offers(events: DataFrame, offers: DataFrame) -> DataFrame:
    """(key, offer, rank): the offer of an event's day that suits it best.

    events: key, day, venue, name; offers: offer, day, venue, name, ord. A shared venue word weighs 2, all words of the
    offer's name among the event's 1; of equals the first offer stays. Of offers that are alike in what a rank asks for (day and venue word for 2,
    the name too for 3, day and name for 1) only the first can stay, so events meet one offer for each of their venue words and the names that theirs
    holds, however many events and offers a day has.
    """
    names = lambda c: F.array_sort(F.array_distinct(F.split(normalized(c), " ")))
    e = saved(events.select("key", "day", F.array_distinct(_long_words(venue_key("venue"), 3)).alias("v"), names("name").alias("s")))
    first = F.min(F.struct("ord", "offer")).alias("first")
    o = offers.where("day is not null").select("day", F.array_distinct(_long_words(venue_key("venue"), 3)).alias("v"), F.filter(names("name"), lambda w: w != "").alias("os"), "ord", "offer")
    o = saved(o.groupBy("day", "v", "os").agg(first))
    held = saved(holding_names(e, o))
    least = F.min("first").alias("first")
    at = o.select("day", F.explode("v").alias("w"), "os", "first")
    mine = e.select("key", "day", F.explode("v").alias("w"), "s")
    named = e.select("day", "s").distinct().join(held, "s").join(o.groupBy("day", "os").agg(least), ["day", "os"]).groupBy("day", "s").agg(least)
    found = [
        mine.join(held, "s").join(at.groupBy("day", "w", "os").agg(least), ["day", "w", "os"]).withColumn("rank", F.lit(3)),
        mine.join(at.groupBy("day", "w").agg(least), ["day", "w"]).withColumn("rank", F.lit(2)), e.join(named, ["day", "s"]).withColumn("rank", F.lit(1)),
    ]
    met = reduce(DataFrame.union, [f.select("key", F.struct((-F.col("rank")).alias("turn"), "first").alias("best")) for f in found])
    return met.groupBy("key").agg(F.min("best").alias("best")).select("key", F.col("best.first.offer").alias("offer"), (-F.col("best.turn")).alias("rank"))


def group_matrix(scores: DataFrame) -> DataFrame:
    """(key, people, mean, least, most, n_into, n_veto) of long rows (person, key, score, rating): one pass, however many people."""
    person = F.struct("person", "score", "rating", (F.col("score") < 0).alias("veto"))
    return scores.groupBy("key").agg(
        F.array_sort(F.collect_list(person)).alias("people"), F.bround(F.avg("score"), 2).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"),
        F.count_if(F.col("score") > 0).alias("n_into"), F.count_if(F.col("score") < 0).alias("n_veto"),
    )


def dense_matrix(pools: DataFrame, members: DataFrame, shown: tuple[str, ...] = ("title", "day", "venue", "neighborhood", "price", "links")) -> DataFrame:
    """One row for each key in anyone's pool, with every member's cell: key, the columns ``shown`` of the first member's row that has it, people,
    mean, least, most, n_into, n_veto.

    pools: person, key, turn (a row's place in the pool), score, rating, reasons (array), and what is shown; where a pool repeats a key its last row counts.
    members: person, turn; people outside it don't count, and of one who stands there twice the first turn does. ``people`` is an array by the members' turns of (person, cell), the cell
    null where the key isn't in a person's pool, else (score, rating, reasons: the first three, veto); null scores and ratings are 0. One aggregation by person
    and key and one by key, however many people; the members' list, a row a member, is joined to keys only as one array, so it is as long as one row may be.
    """
    asked = members.where("person is not null").groupBy("person").agg(F.min("turn").alias("_m"))
    kept = [c for c in shown if c in pools.columns]
    cell = F.struct(
        F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("rating", F.lit(0)).alias("rating"),
        F.slice(F.coalesce("reasons", F.array().cast("array<string>")), 1, 3).alias("reasons"), (F.coalesce("score", F.lit(0)) < 0).alias("veto"),
    )
    rows = pools.join(asked, "person").groupBy("person", "_m", "key").agg(F.max_by(F.struct(cell.alias("cell"), F.struct(F.lit(1).alias("_"), *kept).alias("row")), "turn").alias("_r"))
    rows = rows.select("key", "person", "_m", "_r.cell", "_r.row").withColumn("_s", F.col("cell.score"))
    met = rows.groupBy("key").agg(
        F.min_by("row", F.struct("_m", "person")).alias("row"), F.map_from_entries(F.collect_list(F.struct("person", "cell"))).alias("cells"), F.bround(F.avg("_s"), 2).alias("mean"),
        F.min("_s").alias("least"), F.max("_s").alias("most"), F.count_if(F.col("_s") > 0).alias("n_into"), F.count_if(F.col("_s") < 0).alias("n_veto"),
    )
    everyone = asked.agg(F.transform(F.array_sort(F.collect_list(F.struct("_m", "person"))), lambda m: m["person"]).alias("everyone"))
    people = F.transform("everyone", lambda p: F.struct(p.alias("person"), F.try_element_at("cells", p).alias("cell")))
    return met.crossJoin(F.broadcast(everyone)).select("key", *[f"row.{c}" for c in kept], people.alias("people"), "mean", "least", "most", "n_into", "n_veto")  # one row beside


def matrix_order(matrix: DataFrame) -> DataFrame:
    """A matrix by its mean, the best first, then by day, undated rows last, then by key."""
    return matrix.orderBy(F.desc("mean"), F.asc_nulls_last("day"), "key")


def radar_signals(hay: Column, venue: Column, tracked: Column, big_venues: tuple[str, ...], editorial: Column | None = None, civic: Column | None = None) -> Column:
    """The signals that a listing fires, in order; ``tracked`` is an array of names, ``civic`` a gate on that signal."""
    names = F.concat(F.lit("tracked:"), F.array_join(F.slice(tracked, 1, 2), ","))
    options = [
        F.when(editorial if editorial is not None else F.lit(False), F.lit("editorial")), F.when(has_any(hay, FESTIVAL_TERMS), F.lit("festival")),
        F.when(F.size(tracked) > 0, names), F.when(has_any(F.lower(venue), big_venues), F.lit("big-venue")),
    ]
    if civic is not None:
        options.append(F.when(civic & has_any(hay, CIVIC_TERMS), F.lit("civic")))
    return F.filter(F.array(*options), lambda x: x.isNotNull())


def radar_rank(score: Column, signals: Column) -> Column:
    """Weights of the signals, and a tenth of the score."""
    weights = F.create_map(*[F.lit(x) for kv in RADAR_WEIGHTS.items() for x in kv])
    total = F.aggregate(signals, F.lit(0), lambda a, s: a + F.coalesce(F.try_element_at(weights, F.get(F.split(s, ":"), F.lit(0))), F.lit(0)))
    return total + F.coalesce(score, F.lit(0)) / 10.0


def concordance(judged: DataFrame) -> DataFrame:
    """(pairs, concordant): over pairs of rows of different tier rank, how often the better one has the higher score, ties half.

    judged: tier_rank, score. Rows are counted by both first, so pairs of counts are few.
    """
    counts = judged.groupBy("tier_rank", "score").agg(F.count(F.lit(1)).alias("n"))
    a, b = counts.select(*[F.col(c).alias(f"a_{c}") for c in counts.columns]), counts.select(*[F.col(c).alias(f"b_{c}") for c in counts.columns])
    met = a.join(b, F.col("a_tier_rank") > F.col("b_tier_rank"))
    pairs = F.col("a_n") * F.col("b_n")
    worth = F.when(F.col("a_score") > F.col("b_score"), 1.0).when(F.col("a_score") == F.col("b_score"), 0.5).otherwise(0.0)
    return met.agg(F.sum(pairs).alias("pairs"), F.sum(pairs * worth).alias("concordant"))


def displacement(judged: DataFrame) -> DataFrame:
    """(n, mean_pct, p90_pct, max_pct): how far rows move, in percent of all, from the order by score to that by ``rank_score``; judged: key, score, rank_score.

    Places come from counts by score and key prefix, so the rows don't meet in one task; under five rows there is no result.
    """
    rows = judged.where("score is not null").select("key", "score", "rank_score")
    placed = global_rank(global_rank(rows, "score", "key", "was"), "rank_score", "key", "now")
    n = placed.agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    moves = placed.crossJoin(F.broadcast(n)).select("n", (F.abs(F.col("was") - F.col("now")) / F.col("n") * 100).alias("move"))  # one row beside
    counts = moves.groupBy("n", "move").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("n").orderBy("move").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_upto", upto)
    tenth = F.min(F.when(F.col("_upto") > F.floor(F.col("n") * 0.9), F.col("move")))
    return counts.groupBy("n").agg(F.bround(F.sum(F.col("move") * F.col("c")) / F.first("n"), 1).alias("mean_pct"), F.bround(tenth, 1).alias("p90_pct"), F.bround(F.max("move"), 1).alias("max_pct"))


def disagreements(judged: DataFrame) -> DataFrame:
    """Verdicts that the score wouldn't have given (key, tier, adjust, score), with ``kinds`` and ``score_pct``, the share of lower scores.

    Scores are counted first, so the shares come from a row a score.
    """
    rows = judged.where("score is not null")
    counts = rows.groupBy(F.col("score").alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    below = F.sum("_c").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    shares = counts.select("_s", (below / F.sum("_c").over(Window.partitionBy()) * 100).alias("_p"))
    kinds = F.array_compact(F.array(
        F.when(F.col("tier").isin("must-see", "great") & (F.col("_p") <= 40), "promoted_low_score"), F.when((F.col("tier") == "skip") & (F.col("_p") >= 75), "demoted_high_score"),
        F.when(F.abs(F.coalesce("adjust", F.lit(0))) >= 3, "big_adjust"),
    ))
    found = rows.join(shares, F.col("score") == F.col("_s")).withColumns({"kinds": kinds, "score_pct": F.bround("_p", 0).cast("long")})
    return found.where(F.size("kinds") > 0).drop("_s", "_p")
