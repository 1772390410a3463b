"""Six axes of a listing: type, genre, setting, scale, vibe and region, each from ordered rules.

Rules are regular expressions in a fixed order, compiled into one projection; gazetteers of venues are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import dates
from lumenfold.functions.text import has_any, text

# The types, and genre rules in their order, specific ones before general ones.
TYPES = ("club", "live-music", "film", "stage", "comedy", "market", "workshop", "art", "food-drink", "community", "other")
LANES = (*(t for t in TYPES if t != "club"), "live-music:big", "club:mainstream", "club:afters", "club:day", "club:underground")
MUSIC_CATEGORIES = ("music", "live_music", "jazz", "electronic", "party")
ELECTRONIC = (
    ("tech-house", r"tech[\s-]?house"), ("deep-house", r"deep[\s-]?house"), ("afro-house", r"afro[\s-]?house|afrohouse"), ("melodic", r"melodic"),
    ("progressive", r"progressive|prog house"), ("house", r"house"), ("hard-techno", r"hard[\s-]?techno"),
    ("hard-dance", r"hardstyle|gabber|happy[\s-]?hardcore|hard[\s-]?dance|hardcore|donk"), ("techno", r"techno"), ("minimal", r"minimal"),
    ("acid", r"acid"), ("electro", r"electro(?!nic)"), ("disco", r"disco|italo|nu-?disco"), ("psytrance", r"psy[\s-]?trance"), ("trance", r"trance"),
    ("dnb", r"dnb|drum[\s&]?and[\s&]?bass|drum ?& ?bass|(?<!at )jungle"), ("dubstep", r"dubstep|riddim|brostep"), ("reggae", r"reggae|dancehall"),
    ("dub", r"(?<![\w-])dub(?![\w-])"), ("ambient", r"ambient|downtempo"), ("amapiano", r"amapiano"), ("garage", r"ukg|uk garage|speed garage|garage"),
    ("breakbeat", r"breakbeat|breaks"), ("bass", r"bass music|bassline"), ("edm", r"edm|big[\s-]?room"),
)
SHADOWS = {"tech-house": "house", "deep-house": "house", "afro-house": "house", "hard-techno": "techno", "psytrance": "trance"}
LIVE = (
    ("jazz", r"jazz"), ("funk-soul", r"funk|soul|motown|r&b|rnb"), ("hip-hop", r"hip[\s-]?hop|rap"), ("punk", r"punk|hardcore"), ("metal", r"metal"),
    ("indie", r"indie"), ("folk", r"folk|americana|singer[\s-]?songwriter"), ("rock", r"rock|garage"), ("country", r"country"),
    ("latin", r"latin|cumbia|salsa|reggaeton|mariachi|banda"), ("experimental", r"experimental|noise|avant"),
    ("classical", r"classical|orchestra|symphony|chamber|philharmonic"), ("blues", r"blues"), ("pop", r"pop(?![\s-]?up)"),
)
STAGE = (("musical", r"\bmusical\b"), ("ballet", r"ballet|nutcracker"), ("opera", r"\bopera\b"))
COMEDY = (("improv", r"\bimprov\b|improvised"), ("open-mic", r"open[\s-]?mic"), ("standup", r"stand[\s-]?up|standup"), ("sketch", r"\bsketch\b"), ("podcast", r"\bpodcast\b|\btaping\b"))
LIVE_BY_SOURCE = {
    "rock": "rock", "pop": "pop", "hip-hop/rap": "hip-hop", "latin": "latin", "country": "country", "r&b": "funk-soul", "metal": "metal", "alternative": "indie",
    "folk": "folk", "jazz": "jazz", "classical": "classical", "blues": "blues", "reggae": "reggae", "dance/electronic": "electronic", "world": "world",
    "folk/acoustic/americana": "folk", "edm": "electronic",
}
#: Genres that tags name in another way than a rule's name.
OTHER_GENRES = ("rep/arthouse", "electronic", "world", "theater", "family", "dance", "performance-art", "magic", "circus", "variety", "puppetry")
STAGE_BY_SOURCE = {
    "theatre": "theater", "miscellaneous theatre": "theater", "children's theatre": "family", "dance": "dance", "classical": "classical", "opera": "opera",
    "performance art": "performance-art", "magic & illusion": "magic", "circus & specialty acts": "circus", "variety": "variety", "puppetry": "puppetry",
    "multimedia": "performance-art",
}
# Words of settings, of watch parties, stages and live music, of cinemas, comedy, markets, workshops and clubs.
SETTINGS = (
    ("rooftop", r"\brooftop\b"), ("warehouse", r"\bwarehouse\b"), ("outdoor", r"\b(outdoor|open[\s-]?air|backyard|patio|garden|courtyard)\b"), ("pool", r"\b(pool|poolside)\b"),
    ("listening-bar", r"\b(listening bar|listening room|all[\s-]?vinyl)\b"), ("gallery", r"\b(gallery|museum)\b"),
)
_WATCH, _TOURNEY = r"\b(watch|viewing) part(y|ies)\b|\bsemi-?finals?\b|\bquarter-?finals?\b", r"\bworld cup\b|\bfifa\b"
_MATCH, _AFTER = r"\bfinals?\b|\bsemi\b|\bplay-?offs?\b|\bvs\.?\b|\bmatch(es)?\b|\bweek\b", r"\bafter[\s-]?part(y|ies)\b"
_CLUB_TITLE = r"^\s*dj\b|\bdj (set|night)\b|\b(with|w/)\s+dj\b|\b(dance|disco|house) party\b|\brave\b|\bb2b\b|\bwarehouse\b|\bafters\b|\bday party\b|\bdisko\b|\bafrobeats\b|\bamapiano\b"
_STAGE_WORD, _STAGE_TITLE = r"\(touring\)|\b(ballet|circus|stage show|the musical)\b", r"\bballet|\b(broadway|nutcracker|the musical|opera)\b"
_LIVE_TITLE = r"\b(banda|corridos?|cumbia|sonidero|mariachi|music festival)\b"
_LIVE_DETAIL = r"\bbands?\b|\bin concert\b|\blive (music|show|performance)\b|\bheadlin\w+\b|\b(on|world|north american) tour\b"
_CINEMA = r"\b(screening|matin[eé]e|double feature|q&a|q & a|35mm|70mm|16mm|film series|cinema)\b"
_COMEDY, _MARKET = r"\b(comedy|stand[\s-]?up|standup|improv|open mic)\b", r"\b(market|flea|bazaar|farmers|swap meet|vintage fair)\b"
_WORKSHOP, _AFTERS = r"\b(workshop|class|seminar)\b", r"\bafter[\s-]?hours?\b|\bafters\b"
_DJ = r"\b(dj set|b2b|warehouse|rave|afters|after[\s-]?hours|after[\s-]?part(?:y|ies)|day party)\b"

# Every alternative of the patterns that flags look for in the whole text: those at the beginning of a word, and others (but "burlesque", which is looked for always). A text without any has no such flag.
_SAID = (
    r"\b21\s?\+", r"\b18\s?\+", r"\bafter[\s-]?hours?\b", r"\bafters\b", r"\b(sunset|golden hour)\b", r"\b(all[\s-]?vinyl|vinyl[\s-]?only)\b",
    r"\bb2b\b", r"\b(residency|residencies)\b", r"\bresident\b(?!\s+advisor)", r"\b(queer|lgbtq|pride|gay|sapphic)\b", r"\bdrag\b",
    r"\b(tributes?|cover band)\b", r"\b(album|record|ep) release\b", r"\b(35mm|70mm|16mm)\b", r"\bq&a", r"\bin person\b", r"\bin attendance\b",
    r"\bin conversation\b", r"\bintroduced by\b", r"\bblock party\b", r"\bpop[\s-]?up\b", r"\bboat party\b", r"\byacht party\b", r"\b(location )?tba\b",
    r"\bsold out\b", r"\ball ages\b",
)
_SAID_WITHIN = (
    r"open[\s-]?to[\s-]?close", r"all[\s-]?night\s?(long|set)", r"\[all night|extended set", r"21 and over\b", r"18 and over\b", r"q & a\b",
    r"q ?& ?a with", r"drops? (after|day)",
)
_ANY_SAID = r"\b(?:" + "|".join(_SAID) + ")|" + "|".join(_SAID_WITHIN)


@dataclass(frozen=True)
class Gazetteer:
    """What is known of venues and places, by lower-case substrings of their names."""

    setting: dict[str, tuple[str, ...]] = field(default_factory=dict)
    genre: dict[str, tuple[str, ...]] = field(default_factory=dict)
    scale: dict[str, str] = field(default_factory=dict)
    live_rooms: tuple[str, ...] = ()
    stages: tuple[str, ...] = ()
    cinemas: tuple[str, ...] = ()
    casinos: tuple[str, ...] = ()
    headliners: tuple[str, ...] = ()
    regions: dict[str, tuple[str, ...]] = field(default_factory=dict)
    near_home: tuple[str, ...] = ()


#: Every genre that a tag can name.
GENRES = tuple(dict.fromkeys([*(n for n, _ in (*ELECTRONIC, *LIVE, *STAGE, *COMEDY)), *OTHER_GENRES]))


#: What ``tagged`` computes once a row before the rules read it.
_READY = "_of_"


def _low(df: DataFrame, name: str) -> Column:
    if _READY + name in df.columns:
        return F.col(_READY + name)
    return F.lower(text(name)) if name in df.columns else F.lit("")


def _bill(df: DataFrame) -> Column:
    if f"{_READY}bill" in df.columns:
        return F.col(f"{_READY}bill")
    return F.lower(F.coalesce(F.array_join("lineup", " "), F.lit(""))) if "lineup" in df.columns else F.lit("")


def once(c: Column) -> Column:
    """``c``, which the optimizer neither repeats where it is used nor carries below in filters, as its condition isn't deterministic."""
    return F.when(F.spark_partition_id() >= 0, c)


def _some(options: list[tuple[Column, str]]) -> Column:
    """The names whose condition holds, in order, each once."""
    if not options:
        return F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in options]), lambda x: x.isNotNull()))


def _words(rules: tuple[tuple[str, str], ...]) -> str:
    return r"\b(" + "|".join(p for _, p in rules) + r")\b"


def _hay(df: DataFrame, venue: bool = True) -> Column:
    """Title, organisers, detail, venue and bill in one text; or all but the venue."""
    name = _READY + ("hay" if venue else "told")
    if name in df.columns:
        return F.col(name)
    return F.concat_ws(" ", _low(df, "title"), _low(df, "organizers"), _low(df, "detail"), *([_low(df, "venue")] if venue else []), _bill(df))


def _gated(hay: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The names of rules that a text fires, as whole words; most texts fire none, which one pattern of all tells."""
    return F.when(hay.rlike(_words(rules)), _some([(hay.rlike(rf"\b({p})\b"), n) for n, p in rules])).otherwise(F.array().cast("array<string>"))


def type_of(df: DataFrame, g: Gazetteer) -> Column:
    """The one kind of a listing: the first rule that holds."""
    cat, genre, bill_genre = F.trim(_low(df, "category")), F.trim(_low(df, "genre")), F.trim(_low(df, "lineup_genre"))
    title, venue, detail = _low(df, "title"), _low(df, "venue"), _low(df, "detail")
    sources = F.coalesce("sources", F.array().cast("array<string>")) if "sources" in df.columns else F.array().cast("array<string>")
    music = cat.isin(*MUSIC_CATEGORIES)
    hay = _hay(df)
    where = F.when(music, F.concat_ws(" ", title, venue)).otherwise(hay)
    ghay = _hay(df, venue=False)
    arts, stages = cat == "arts & theatre", list(STAGE_BY_SOURCE)
    watch = ~title.rlike(_AFTER) & (title.rlike(_WATCH) | (title.rlike(_TOURNEY) & title.rlike(_MATCH)))
    electronic = _words(ELECTRONIC)
    live_room = has_any(venue, g.live_rooms + tuple(g.genre)) & ~genre.eqNullSafe("dance/electronic") & ~bill_genre.eqNullSafe("dance/electronic")
    club = cat.isin("electronic", "party") | F.arrays_overlap(sources, F.array(*map(F.lit, ("ra", "19hz", "posh")))) | where.rlike(_DJ)
    blank = cat.isin("", "undefined", "general", "miscellaneous", "event", "festival")
    dance = (genre == "dance/electronic") & (has_any(F.concat_ws(" ", title, _bill(df)), g.headliners) | title.rlike(r"\brave\b|\b(dance|disco) party\b|\bdisko\b"))
    return (
        F.when(watch, "community").when(cat.isin("market", "flea", "food_market", "farmers_market"), "market")
        .when((cat == "film") | where.rlike(_CINEMA), "film")
        .when(arts & genre.isin(stages), F.when(title.rlike(_COMEDY) | detail.rlike(r"stand[\s-]?up|\bpodcast\b"), "comedy").otherwise("stage"))
        .when((cat == "comedy") | (genre == "comedy") | (bill_genre == "comedy") | where.rlike(_COMEDY), "comedy")
        .when(cat.isin("theater", "dance"), "stage").when(arts & bill_genre.isin(stages), "stage")
        .when(arts & (hay.rlike(_STAGE_WORD) | title.rlike(_STAGE_TITLE)), "stage").when(arts & title.rlike(_LIVE_TITLE), "live-music").when(arts, "other")
        .when(~music & where.rlike(_MARKET), "market").when(~music & where.rlike(_WORKSHOP), "workshop")
        .when(club & live_room & ~title.rlike(_CLUB_TITLE) & ~ghay.rlike(electronic), "live-music").when(club, "club")
        .when(cat.isin("music", "live_music", "jazz"), F.when(dance, "club").otherwise("live-music"))
        .when(blank & has_any(venue, g.live_rooms), "live-music").when(blank & has_any(venue, g.stages), "stage")
        .when(blank & (title.rlike(_STAGE_WORD) | title.rlike(_STAGE_TITLE)), "stage").when(blank & title.rlike(_LIVE_TITLE), "live-music")
        .when(blank & (detail.rlike(_LIVE_DETAIL) | detail.rlike(_words(LIVE))), "live-music").when(blank & detail.rlike(electronic), "club")
        .when(cat == "art", "art").otherwise("other")
    )


def genres_of(df: DataFrame, typ: Column, g: Gazetteer) -> Column:
    """Subkinds in the order of their rules; a general one goes where a specific one that contains its word is there."""
    hay = _hay(df, venue=False)
    title, venue, own = _low(df, "title"), _low(df, "venue"), F.trim(_low(df, "genre"))
    fired = F.col(f"{_READY}fired") if f"{_READY}fired" in df.columns else _gated(hay, ELECTRONIC)
    shadowed = F.filter(F.array(*[F.when(F.array_contains(fired, a), F.lit(b)) for a, b in SHADOWS.items()]), lambda x: x.isNotNull())
    club = F.array_except(fired, shadowed)
    club = F.when(F.size(club) > 0, club).otherwise(F.array(F.lit("electronic")))
    by_source = lambda m: F.filter(F.array(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), own)), lambda x: x.isNotNull())
    named = F.col(f"{_READY}live") if f"{_READY}live" in df.columns else _gated(hay, LIVE)
    live = F.array_distinct(F.concat(named, by_source(LIVE_BY_SOURCE)))
    rooms = _some([(venue.contains(k), n) for k, names in g.genre.items() for n in names])
    live = F.when(F.size(live) > 0, live).otherwise(rooms)
    stage = F.array_distinct(F.concat(by_source(STAGE_BY_SOURCE), _some([(title.rlike(p), n) for n, p in STAGE])))
    comedy = _some([(hay.rlike(p), n) for n, p in COMEDY])
    film = _some([(has_any(venue, g.cinemas), "rep/arthouse")])
    none = F.array().cast("array<string>")
    return F.when(typ == "club", club).when(typ == "live-music", live).when(typ == "stage", stage).when(typ == "comedy", comedy).when(typ == "film", film).otherwise(none)


def _wanted(options: list[tuple[Column, str]], only: tuple[str, ...] | None) -> list[tuple[Column, str]]:
    return options if only is None else [o for o in options if o[1] in only]


def settings_of(df: DataFrame, g: Gazetteer, only: tuple[str, ...] | None = None) -> Column:
    venue = _low(df, "venue")
    hay = _hay(df)
    known = _some(_wanted([(venue.contains(k), n) for k, names in g.setting.items() for n in names], only))
    cinema = _some(_wanted([(F.lit(True), "cinema")], only)).cast("array<string>")
    known = F.when(has_any(venue, g.cinemas), cinema).otherwise(known.cast("array<string>"))
    told = _wanted([(hay.rlike(p), n) for n, p in SETTINGS], only)
    any_of = r"\b(?:" + "|".join(p for n, p in SETTINGS if only is None or n in only) + ")"
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(known, F.when(hay.rlike(any_of), _some(told)).otherwise(none) if told else none))


def scale_of(venue: Column, setting: Column, g: Gazetteer) -> Column:
    """The venue's tier by the longest name of the gazetteer in it (of equals the first); a pool party isn't the casino's hall."""
    out = None
    for name, tier in sorted(g.scale.items(), key=lambda kv: -len(kv[0])):
        value = F.when(F.array_contains(setting, "pool"), F.lit(None)).otherwise(F.lit(tier)) if tier == "arena" and name in g.casinos else F.lit(tier)
        out = F.when(venue.contains(name), value) if out is None else out.when(venue.contains(name), value)
    rest = F.when(F.array_contains(setting, "amphitheater"), "arena")
    return rest if out is None else out.otherwise(rest)


def vibes_of(df: DataFrame, typ: Column, only: tuple[str, ...] | None = None) -> Column:
    """Flags in their order, some of them for certain types, hours or prices only; of ``only``, if given, no other is looked for."""
    title, venue, price, organizers = _low(df, "title"), _low(df, "venue"), _low(df, "price"), _low(df, "organizers")
    hay = _hay(df)
    h = F.col(f"{_READY}hours") if f"{_READY}hours" in df.columns else dates.hours("start") if "start" in df.columns else F.struct(F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    start, end, club, film = h["first"], h["last"], typ == "club", typ == "film"
    gate = F.col(f"{_READY}said") if f"{_READY}said" in df.columns else F.lit(True)
    said = lambda p: gate & hay.rlike(p)
    all_night = said(r"open[\s-]?to[\s-]?close|all[\s-]?night\s?(long|set)|\[all night|extended set")
    retro = title.rlike(r"(19|20)\d0s|(19|20)\d{2}\s*[-–]\s*(19|20)\d{2}|\bbangers\b|\bclassics\b|throwback")
    over21, over18 = said(r"\b21\s?\+|21 and over\b"), said(r"\b18\s?\+|18 and over\b")
    return _some(_wanted([
        (said(_AFTERS) | (club & F.coalesce(start < 9, F.lit(False))) | (club & F.coalesce((end >= 4) & (end < 12), F.lit(False))), "afterhours"),
        (club & start.between(11, 16), "day-party"), (said(r"\b(sunset|golden hour)\b"), "sunset"), (said(r"\b(all[\s-]?vinyl|vinyl[\s-]?only)\b"), "all-vinyl"),
        (club & all_night & ~retro, "all-night-set"), (said(r"\bb2b\b"), "b2b"), (said(r"\b(residency|residencies)\b|\bresident\b(?!\s+advisor)"), "residency"),
        (said(r"\b(queer|lgbtq|pride|gay|sapphic)\b"), "queer"), (said(r"\bdrag\b"), "drag"), (hay.rlike(r"\bburlesque\b"), "burlesque"),
        (said(r"\b(tributes?|cover band)\b"), "tribute"), (said(r"\b(album|record|ep) release\b"), "album-release"),
        (typ.isin("club", "live-music", "community", "market", "food-drink") & F.concat_ws(" ", title, organizers).rlike(r"\bfestival\b"), "festival"),
        (said(r"\b(35mm|70mm|16mm)\b"), "analog-film"), (typ.isin("film", "comedy", "stage") & said(r"\bq&a|q & a\b"), "q&a"),
        (film & said(r"\bin person\b|\bin attendance\b|\bin conversation\b|\bintroduced by\b|q ?& ?a with"), "guest-in-person"), (film & (start >= 9) & (start < 17), "matinee"),
        ((typ != "comedy") & said(r"\bblock party\b"), "block-party"), (said(r"\bpop[\s-]?up\b"), "pop-up"), (said(r"\bboat party\b|\byacht party\b"), "boat-party"),
        (venue.contains("tba") | said(r"\b(location )?tba\b|drops? (after|day)"), "tba-location"),
        (F.col("ra_pick") if "ra_pick" in df.columns else F.lit(False), "ra-pick"), (price.contains("free"), "free"), (price.contains("free") & price.contains("rsvp"), "free-rsvp"),
        (said(r"\bsold out\b"), "sold-out"), (over21, "21+"), (~over21 & over18, "18+"), (~over21 & ~over18 & said(r"\ball ages\b"), "all-ages"),
    ], only))


def region_of(place: Column, g: Gazetteer) -> Column:
    out = None
    for region, places in g.regions.items():
        hit = place.isin(*[p.lower() for p in places])
        out = F.when(hit, region) if out is None else out.when(hit, region)
    return F.lit(None).cast("string") if out is None else out


def tagged(events: DataFrame, g: Gazetteer = Gazetteer(), only: tuple[str, ...] | None = None) -> DataFrame:  # noqa: B008
    """``events`` with type, genre (as ``genres``), setting, scale, vibe, region, near_home and afters_billed.

    Types, settings and vibes stand once in a plan, which lets no filter past them: filter by day, score or tier first. ``only`` names the settings and
    vibes that are asked for (a lane needs ``score.LANE_FLAGS``), others aren't looked for; a scale needs "pool" and "amphitheater".
    """
    ready = events.withColumns({f"{_READY}{c}": once(_low(events, c)) for c in ("title", "venue", "detail", "organizers", "price")} | {f"{_READY}bill": once(_bill(events))})
    ready = ready.withColumns({f"{_READY}hay": once(_hay(ready)), f"{_READY}told": once(_hay(ready, venue=False))})
    out = ready.withColumns({"type": once(type_of(ready, g)), "setting": once(settings_of(ready, g, only)), f"{_READY}said": once(_hay(ready).rlike(_ANY_SAID))})
    timed = F.col("type").isin("club", "film")  # other types' flags don't ask for hours
    hours = {f"{_READY}hours": once(F.when(timed, dates.hours("start")))} if "start" in events.columns else {}
    told = _hay(out, venue=False)
    out = out.withColumns({f"{_READY}fired": once(F.when(F.col("type") == "club", _gated(told, ELECTRONIC))), f"{_READY}live": once(F.when(F.col("type") == "live-music", _gated(told, LIVE)))} | hours)
    place = F.trim(_low(events, "neighborhood"))
    made = out.withColumns({
        "scale": scale_of(_low(out, "venue"), F.col("setting"), g), "genres": genres_of(out, F.col("type"), g), "vibe": once(vibes_of(out, F.col("type"), only)), "region": region_of(place, g),
        "near_home": place.isin(*[p.lower() for p in g.near_home]) if g.near_home else F.lit(False), "afters_billed": F.col(f"{_READY}said") & _hay(out).rlike(_AFTERS),
    })
    return made.drop(*[c for c in made.columns if c.startswith(_READY)])


def facets(events: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """(axis, value, n): how often each value of the axes occurs, arrays by element; one pass over the events, however many axes."""
    def told(a: str) -> Column:
        values = F.col(a) if events.schema[a].dataType.typeName() == "array" else F.array(a)
        return F.transform(F.coalesce(values.cast("array<string>"), F.array().cast("array<string>")), lambda v: F.struct(F.lit(a).alias("axis"), v.alias("value")))

    pairs = events.select(F.inline(F.concat(*[told(a) for a in axes]))).where("value is not null")
    return pairs.groupBy("axis", "value").agg(F.count(F.lit(1)).alias("n"))
