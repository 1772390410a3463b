"""Text keys as column expressions: normalisation, identities and whole-token tests."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What normalisation turns into a space: all but letters, numbers, underscore and space, of any script.
_PUNCT = r"[^\p{L}\p{N}_\s\p{Z}]"
_SPACE = r"[\s\p{Z}]+"
_VENUE_FILLER = r"\b(the|los angeles|la|dtla|presents|at)\b"
_FEST_FILLER = r"\b(festival|fest|music|edition|presents|day|days|one|two|three|[123]|pass|passes|weekend|weekender|ga|vip|19\d\d|20\d\d)\b"
_FILM_NOISE = (
    r"\b(\d{2,3}\s?mm|4k|8k|imax|dcp|digital|dolby(\s+(vision|atmos|cinema))?|restoration|restored|remaster(ed)?|extended (cut|edition)|"
    r"directors cut|final cut|theatrical cut|uncut|\d{1,3}(st|nd|rd|th) anniversary|anniversary|qanda|q and a|q a)\b"
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: str | Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def normalized(c: str | Column) -> Column:
    """Lower case, ``&`` as "and", punctuation as spaces, runs of space as one."""
    return collapsed(F.regexp_replace(F.replace(F.lower(text(c)), F.lit("&"), F.lit("and")), _PUNCT, " "))


def venue_key(c: str | Column) -> Column:
    """A venue's comparable name: normalised, without filler words."""
    return collapsed(F.regexp_replace(normalized(c), _VENUE_FILLER, " "))


def festival_core(c: str | Column) -> Column:
    """A festival's distinctive name: without an organiser in front of "presents" and without edition words."""
    return collapsed(F.regexp_replace(F.regexp_replace(normalized(c), r"^.*?\bpresents\b[:\s]*", ""), _FEST_FILLER, " "))


def film_core(c: str | Column) -> Column:
    """A film's identity: without a year in brackets and words of format and edition, unless under 3 letters remain."""
    whole = normalized(F.regexp_replace(text(c), r"\(\s*(19|20)\d\d\s*\)", " "))
    core = collapsed(F.regexp_replace(whole, _FILM_NOISE, " "))
    return F.when(F.char_length(core) >= 3, core).otherwise(whole)


def event_key(title: str | Column, day: str | Column, venue: str | Column) -> Column:
    """The 12-digit identity of a listing, of its normalised title, day and normalised venue."""
    return F.substring(F.sha1(F.concat_ws("|", normalized(title), F.substring(text(day), 1, 10), normalized(venue))), 1, 12)


@cache
def _folds() -> tuple[str, str]:
    """Letters that decompose to one letter and marks, and those letters; by rule, for Latin, Greek and Cyrillic."""
    pairs = []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000), 0x212A, 0x212B]:
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if len(bare) == 1 and bare != chr(code):
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(c: str | Column) -> Column:
    """Lower case without accents; combining marks go."""
    return F.lower(F.regexp_replace(F.translate(text(c), *_folds()), r"\p{M}", ""))


def artist_key(c: str | Column) -> Column:
    return collapsed(folded(c))


def genre_key(c: str | Column) -> Column:
    return F.regexp_replace(F.trim(folded(c)), r"[\s_]+", "-")


def link_key(c: str | Column) -> Column:
    """A name for link lookups: folded, letters and digits only."""
    return F.regexp_replace(folded(c), r"[^a-z0-9]+", "")


def person_key(c: str | Column) -> Column:
    """A display name for lookups: without stops and commas."""
    return collapsed(F.regexp_replace(F.lower(text(c)), "[.,]", " "))


def profile_hash(user: str | Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), F.lower(F.trim(text(user)))), 256), 1, 16)


def fold(s: str) -> str:
    """``folded`` for a string of the driver's settings."""
    return "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c)).lower()


def token_pattern(name: str) -> str:
    """Matches a folded name where no letter or digit touches it."""
    return r"(?<![a-z0-9])" + "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in " ".join(fold(name).split())) + r"(?![a-z0-9])"


def has_token(c: Column, name: str) -> Column:
    return c.rlike(token_pattern(name))


def has_any(c: Column, terms: tuple[str, ...]) -> Column:
    """Whether any of the terms is a substring."""
    return c.rlike("|".join(map(re.escape, terms))) if terms else F.lit(False)


def contains_guarded(a: Column, b: Column, least: int = 4) -> Column:
    """Whether one string holds the other, the shorter having ``least`` letters."""
    return (F.least(F.char_length(a), F.char_length(b)) >= least) & (a.contains(b) | b.contains(a))


# DuckDB spellings of the same keys, for the SQL that checks queries.
def sql_norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower(coalesce({x}, '')), '&', 'and'), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"


def sql_event_key(title: str, day: str, venue: str) -> str:
    return f"substr(sha1({sql_norm(title)} || '|' || substr(coalesce({day}::VARCHAR, ''), 1, 10) || '|' || {sql_norm(venue)}), 1, 12)"
