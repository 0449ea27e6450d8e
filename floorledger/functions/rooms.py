"""Room kinds: fixed vocabularies and predicates over kind columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds that are outdoor zones, the common rooms, the core of a building and its words.
OUTDOOR_KINDS = ("lawn", "paving", "driveway", "parking", "deck", "pool", "planter", "play")
COMMON_KINDS = ("lobby", "gym", "community", "guard")
CORE_KINDS = ("lobby", "shaft", "gym", "community", "guard")
CORE_WORDS = r"\b(LOBBY|STAIRS?|STAIRCASE|LIFTS?|HOISTWAY|ELEVATORS?|FIRE CORRIDOR)\b"


def is_outdoor(kind: Column) -> Column:
    return kind.isin(*OUTDOOR_KINDS)


def is_core(kind: Column, name: Column) -> Column:
    """In no flat by itself: common rooms, outdoor zones and rooms of no kind named as the building's core."""
    return kind.isin(*CORE_KINDS) | is_outdoor(kind) | ((kind == "other") & F.upper(name).rlike(CORE_WORDS))


def is_level_kind(kind: Column) -> Column:
    """A room only a level (ground, basement, rooftop, common floor) has."""
    return kind.isin(*[k for k in OUTDOOR_KINDS if k != "planter"], *COMMON_KINDS)
