"""Scores, ratings and lanes as column expressions: one pass, no join but with what was looked up before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.config import TIER_BONUS, Taste
from lumenfold.functions import dates, prices
from lumenfold.functions.text import col, folded, has_any, has_token, text, token_pattern
from lumenfold.operators.components import numbered


def haystack(df: DataFrame) -> Column:
    """The text that terms are looked for in: title, venue, detail, the bill in brackets and quotes, organisers."""
    has = set(df.columns)
    lineup = F.concat(F.lit("["), F.array_join(F.transform("lineup", lambda a: F.concat(F.lit("'"), a, F.lit("'"))), ", "), F.lit("]")) if "lineup" in has else F.lit("[]")
    return F.lower(F.concat_ws(" ", *[text(c) if c in has else F.lit("") for c in ("title", "venue", "detail")], F.coalesce(lineup, F.lit("[]")), text("organizers") if "organizers" in has else F.lit("")))


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0)
    for p in parts:
        out = out + p
    return out


def tracked_hits(title: str, lineup: str | None, taste: Taste) -> Column:
    """The tracked names billed in title or lineup; ambiguous ones must be an entry of the lineup. Sorted."""
    bill = F.coalesce(col(lineup), F.array().cast("array<string>")) if lineup else F.array().cast("array<string>")
    whole = folded(F.concat_ws(" ", text(title), F.array_join(bill, " ")))
    parts = F.flatten(F.transform(bill, lambda a: F.split(folded(a), r"\s+(?:b2b|b3b|vs\.?|×)\s+")))
    entries = F.transform(F.concat(parts, F.transform(parts, lambda p: F.regexp_replace(p, r"\s*\([^()]*\)\s*$", ""))), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    ambiguous = {" ".join(a.lower().split()) for a in taste.ambiguous}
    hits = []
    for name in sorted(taste.tracked):
        key = " ".join(name.lower().split())
        if len(key) >= 2:
            hits.append(F.when(F.array_contains(entries, key) if key in ambiguous else has_token(whole, name), F.lit(name)))
    return F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>")


def venue_loved(venue: str, loved: tuple[str, ...]) -> Column:
    """Whether a venue names a loved one or the other way round, by whole words and without a leading article."""
    v = folded(F.regexp_replace(F.trim(F.regexp_replace(text(venue), r"\s+", " ")), "(?i)^the ", ""))
    out = F.lit(False)
    for name in loved:
        bare = " ".join(name.split())
        bare = bare[4:] if bare.lower().startswith("the ") else bare
        if len(bare) >= 4:
            escaped = F.concat(F.lit(r"(?<![a-z0-9])"), F.regexp_replace(v, r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"(?![a-z0-9])"))
            out = out | v.rlike(token_pattern(bare)) | F.regexp_like(F.lit(bare.lower()), escaped)
    return (v != "") & out


def scored(events: DataFrame, taste: Taste) -> DataFrame:
    """``events`` with ``score``, ``rating`` and ``reasons``. Looked-up columns that are there take part: ``artist_points``,
    ``genre_points``, ``card`` (draw, rarity, lineup_depth, vibes), ``vibe``, ``type``."""
    has = set(events.columns)
    hay, title = F.col("_hay"), "title"
    category = F.lower(F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("general")))
    weights = F.create_map(*[F.lit(x) for kv in taste.category_weights.items() for x in kv])
    base = F.coalesce(F.try_element_at(weights, category), F.lit(1))
    hood = F.lower(F.trim(text("neighborhood"))) if "neighborhood" in has else F.lit("")
    comedy = category == "comedy"
    terms: list[tuple[Column, Column]] = []  # (points, reason)

    def add(points: Column, reason: Column, when: Column) -> None:
        terms.append((F.when(F.coalesce(when, F.lit(False)), points).otherwise(0), F.when(F.coalesce(when, F.lit(False)), reason)))

    signed = lambda n: F.format_string("%+d", n)
    level = F.when(base == 3, "high").when(base == 2, "medium").otherwise("low")
    add(base, F.concat(signed(base), F.lit(" "), F.replace(category, F.lit("_"), F.lit(" ")), F.lit(" ("), level, F.lit(" interest)")), ~comedy)
    add(base, F.lit("+1 comedy (low interest)"), comedy)
    funny = has_any(hay, tuple(c.lower() for c in taste.comedians))
    add(F.lit(4), F.lit("+4 favorite comedian"), comedy & funny)
    add(F.lit(-2), F.lit("-2 comedy not generally wanted"), comedy & ~funny)
    hits = tracked_hits(title, "lineup" if "lineup" in has else None, taste)
    add(F.size(hits) * 2, F.concat(signed(F.size(hits) * 2), F.lit(" tracked artist ("), F.array_join(hits, ", "), F.lit(")")), F.size(hits) > 0)
    add(F.lit(1), F.lit("+1 venue you love"), venue_loved("venue", taste.venues_loved))
    film = (category == "film") | (F.col("type") == "film" if "type" in has else F.lit(False))
    for names, each, label in ((taste.directors, 2, "tracked director"), (taste.formats, 1, "loved film format")):
        found = F.filter(F.array(*[F.when(hay.rlike(r"\b" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in n.lower()) + r"\b"), F.lit(n)) for n in names]), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")
        add(F.size(found) * each, F.concat(signed(F.size(found) * each), F.lit(f" {label} ("), F.array_join(found, ", "), F.lit(")")), film & (F.size(found) > 0))
    for c, reason in (("afterhours", "+1 afterhours / late start"), ("ra_pick", "+1 RA pick")):
        if c in has:
            add(F.lit(1), F.lit(reason), F.col(c))
    add(F.lit(1), F.lit("+1 rooftop / vinyl / groove"), has_any(hay, taste.groove))
    add(F.lit(1), F.lit("+1 European / label vibe"), has_any(hay, taste.labels))
    add(F.lit(1), F.lit("+1 Friday/Saturday night"), F.weekday("day").isin(4, 5))
    add(F.lit(1), F.lit("+1 close to home"), hood.isin(*[h.lower() for h in taste.near_home]) if taste.near_home else F.lit(False))
    if "editorial_mentions" in has:
        n = F.coalesce(F.size("editorial_mentions"), F.lit(0))
        add(n, F.concat(signed(n), F.lit(" editorial mention ("), F.array_join("editorial_mentions", ", "), F.lit(")")), n > 0)
    if "artist_points" in has:
        add(F.col("artist_points").cast("int"), F.concat(signed(F.col("artist_points")), F.lit(" billed artists")), F.coalesce("artist_points", F.lit(0)) != 0)
    if "genre_points" in has:
        add(F.col("genre_points").cast("int"), F.concat(signed(F.col("genre_points")), F.lit(" on-taste genre")), F.coalesce("genre_points", F.lit(0)) != 0)
    add(F.lit(-5), F.lit("-5 venue you've banned"), has_any(F.lower(text("venue")), tuple(v.lower() for v in taste.venues_banned)))
    for term in taste.penalty:
        add(F.lit(-2), F.lit(f"-2 {term}"), hay.contains(term))
    card = {f.name for f in events.schema["card"].dataType.fields} if "card" in has else set()
    vibes = [F.coalesce(c, F.array().cast("array<string>")) for c in ([F.col("vibe")] if "vibe" in has else []) + ([F.col("card.vibes")] if "vibes" in card else [])]
    if vibes:
        said = F.transform(F.concat(*vibes), F.lower)
        for v in taste.penalty_vibes:
            add(F.lit(-6), F.lit(f"-6 vibe you've opted out of ({v.lower()})"), F.array_contains(said, v.lower()))
    far = has_any(hay, taste.far) | has_any(hood, taste.far)
    festival = hay.contains("festival") | (F.coalesce("festival", F.lit(False)) if "festival" in has else F.lit(False))
    add(F.lit(0), F.lit("far-flung penalty waived (festival)"), far & festival)
    add(F.lit(-2), F.lit("-2 far from LA"), far & ~festival)
    if "card" in has and taste.card_cap > 0:
        number = lambda f: F.coalesce(F.col(f"card.{f}"), F.lit(0))
        parts = [(F.greatest(number("draw"), F.lit(0)), "draw"), (F.greatest(number("rarity"), F.lit(0)), "rare booking"), (F.when(number("lineup_depth") >= 2, 1).otherwise(0), "stacked bill")]
        points = F.least(F.lit(taste.card_cap), _sum([n for n, _ in parts]))
        told = F.array_join(F.array_compact(F.array(*[F.when(n > 0, F.concat(signed(n), F.lit(f" {what}"))) for n, what in parts])), ", ")
        add(points, F.concat(signed(points), F.lit(" event card ("), told, F.lit(")")), points > 0)
    out = events.withColumn("_hay", haystack(events))
    out = out.withColumns({"score": _sum([p for p, _ in terms]).cast("int"), "reasons": F.filter(F.array(*[r for _, r in terms]), lambda x: x.isNotNull())})
    return out.withColumn("rating", rating(F.col("score"), taste)).drop("_hay")


def rating(score: Column, taste: Taste) -> Column:
    """Stars for a score, by the largest threshold that it reaches."""
    out = None
    for least, stars in sorted(taste.thresholds, key=lambda t: -t[0]):
        out = F.when(score >= least, stars) if out is None else out.when(score >= least, stars)
    return out.otherwise(1) if out is not None else F.lit(1)


def tier_bonus(tier: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TIER_BONUS.items() for x in kv]), tier), F.lit(0))


def rank_score(score: Column, adjust: Column, tier: Column) -> Column:
    """What everything is ranked by: score, a verdict's adjustment and its bounded bonus."""
    return F.coalesce(score, F.lit(0)) + F.coalesce(adjust, F.lit(0)) + tier_bonus(tier)


def global_rank(rows: DataFrame, score: str, key: str, out: str = "final_rank") -> DataFrame:
    """``rows`` with their place by score and key, both descending, nulls last, by one sort over ranges: no task has more than its range."""
    placed = numbered(rows, [], [F.desc_nulls_last(score), F.desc_nulls_last(key)], "_place")
    return placed.withColumn(out, F.col("_place") + 1).drop("_place")


#: The settings and vibes that a lane, or the front page's section of one, depends on.
LANE_FLAGS = ("afterhours", "day-party", "sunset", "tba-location", "festival", "rooftop", "pool", "outdoor", "warehouse", "diy", "amphitheater")


def lane(df: DataFrame, big_venues: tuple[str, ...] = (), override: Column | None = None, lanes: tuple[str, ...] = ()) -> Column:
    """The lane of a tagged listing (type, vibe, setting, scale, start, price, afters_billed); a valid override of a verdict wins,
    but a bare family gives way to the sub-lane found here."""
    vibe, setting = F.col("vibe"), F.col("setting")
    has = lambda a, *xs: F.arrays_overlap(a, F.array(*map(F.lit, xs)))
    big = F.coalesce(F.col("scale").isin("hall", "arena"), F.lit(False)) | F.array_contains(setting, "amphitheater") | has_any(F.lower(text("venue")), big_venues)
    underground = has(setting, "warehouse", "diy") | F.array_contains(vibe, "tba-location")
    main = F.coalesce(dates.hours("start")["first"].between(9, 23), F.lit(False))
    dear = F.coalesce(prices.most_whole_amount("price") >= 70, F.lit(False))
    club = (
        F.when(F.array_contains(vibe, "afterhours") & (F.col("afters_billed") | ~(underground & main)), "club:afters")
        .when(has(vibe, "day-party", "sunset") | has(setting, "rooftop", "pool", "outdoor"), "club:day")
        .when(underground, "club:underground")
        .when(F.array_contains(vibe, "festival") | big | dear, "club:mainstream")
        .otherwise("club:underground")
    )
    found = F.when(F.col("type") == "club", club).when((F.col("type") == "live-music") & big, "live-music:big").otherwise(F.coalesce("type", F.lit("other")))
    if override is None:
        return found
    bare = found.contains(":") & (override == F.split(found, ":")[0])
    return F.when(override.isin(*lanes) & ~bare, override).otherwise(found)
