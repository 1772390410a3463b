"""What a profile asks for, resolved once on the driver and compiled into column expressions.

Values of a key come whole from the mechanism settings, else from the taste settings, else from the defaults below;
they are never merged.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

# The default weights, terms and thresholds that scores depend on.
CATEGORY_WEIGHTS = {
    "electronic": 3, "party": 3, "film": 3, "music": 2, "live_music": 2, "theater": 2, "beer_food": 2,
    "comedy": 1, "art": 1, "pop": 1, "general": 1,
}
GROOVE_TERMS = (
    "vinyl", "all night", "open to close", "open-to-close", "groove", "disco", "soulful", "deep house", "balearic", "rooftop",
    "sunset", "golden hour", "open-air", "open air", "daytime", "day party", "poolside", "pool party",
)
NEAR_HOME = (
    "silver lake", "silverlake", "echo park", "los feliz", "east hollywood", "atwater village", "atwater", "frogtown", "elysian valley",
    "highland park", "eagle rock", "glassell park", "cypress park", "lincoln heights", "chinatown", "virgil village", "westlake",
    "historic filipinotown", "downtown", "dtla", "arts district",
)
LABEL_TERMS = (
    "fabric", "defected", "innervisions", "keinemusik", "hot creations", "rush hour", "running back", "anjuna", "afterlife", "dirtybird",
    "hot since", "solid grooves",
)
FAR_TERMS = ("anaheim", "santa ana", "irvine", "san diego", "temecula", "ventura", "riverside", "long beach", "costa mesa", "huntington beach")
PENALTY_TERMS = (
    "bottle service", "bottle-service", "vip table", "table service", "top 40", "top-40", "open format", "open-format", "hip hop",
    "hip-hop", "hardstyle", "gabber", "dubstep", "riddim", "brostep", "tribute", "cover band", "watch party", "world cup", "fifa",
    "sports bar", "trivia", "bingo", "open mic", "karaoke", "networking", "webinar", "workshop", "virtual", "zoom", "mega-rave",
    "mega rave", "edm festival",
)
RATING_THRESHOLDS = ((8, 5), (6, 4), (4, 3), (2, 2))
TIER_BONUS = {"must-see": 3, "great": 2, "solid": 1, "skip": -5}
TIER_POINTS = {"core": 2, "strong": 1, "light": 1, "hidden": -3}
TIER_FLOORS = (("core", 3.0), ("strong", 1.8), ("light", 0.8))
SIGNAL_WEIGHTS = {"top_long": 3.0, "top_medium": 2.0, "top_short": 1.5, "followed": 2.0, "recent": 1.0}
REACTION_WEIGHTS = {"loved": 2.0, "went": 1.5, "clicked_ticket": 0.5, "added_calendar": 0.5, "skipped": -0.5, "hide": -10.0}
HIDING_KINDS = ("hide", "never", "block")
RADAR_WEIGHTS = {"editorial": 3, "festival": 2, "tracked": 2, "civic": 2, "big-venue": 1}


@dataclass(frozen=True)
class Taste:
    """The terms and numbers that a score reads. Empty collections ask for nothing."""

    category_weights: Mapping[str, int] = field(default_factory=lambda: CATEGORY_WEIGHTS)
    tracked: tuple[str, ...] = ()
    ambiguous: tuple[str, ...] = ()
    venues_loved: tuple[str, ...] = ()
    venues_banned: tuple[str, ...] = ()
    comedians: tuple[str, ...] = ()
    directors: tuple[str, ...] = ()
    formats: tuple[str, ...] = ()
    genres_loved: tuple[str, ...] = ()
    near_home: tuple[str, ...] = NEAR_HOME
    groove: tuple[str, ...] = GROOVE_TERMS
    labels: tuple[str, ...] = LABEL_TERMS
    penalty: tuple[str, ...] = PENALTY_TERMS
    penalty_vibes: tuple[str, ...] = ()
    far: tuple[str, ...] = FAR_TERMS
    thresholds: tuple[tuple[int, int], ...] = RATING_THRESHOLDS
    card_cap: int = 4
    artist_cap: int = 4
    genre_points: int = 1
    genre_cap: int = 1
    genre_threshold: float = 0.5
    least_name: int = 3


def resolved(mechanism: Mapping[str, Any] | None = None, taste: Mapping[str, Any] | None = None) -> Taste:
    """A Taste from two nested settings, each key whole from the first that has it."""
    found = {}
    for f in fields(Taste):
        for layer in (mechanism, taste):
            value = (layer or {}).get(f.name)
            if value is not None:
                found[f.name] = tuple(value) if isinstance(value, list) else value
                break
    return Taste(**found)
