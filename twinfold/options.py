"""What a run can be told, and how channels are put together."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Channels with the likeness from which each takes a pair, if it has one.
CHANNELS = {"exact": None, "near": 0.8, "semantic": None, "syntax": None, "abstraction": None}


@dataclass(frozen=True)
class Options:
    """Floors and thresholds of a run; the defaults are those of the queries."""

    min_words: int = 8
    min_lines: int = 5
    min_tokens: int = 24
    threshold: float = 0.5
    cluster_threshold: float = 0.7
    min_shared: int = 24
    min_block: int = 2
    exclude: tuple[str, ...] = ()
    channels: tuple[tuple[str, float | None], ...] = (("exact", None), ("near", 0.8))
    top: int = 30

    def __post_init__(self) -> None:
        for name in ("threshold", "cluster_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} lies between 0 and 1")
        for name in ("min_words", "min_lines", "min_tokens", "min_shared", "min_block", "top"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} is not negative")

    def with_settings(self, settings: dict) -> Options:
        """These with the entries of a settings file (sources.state.settings) over them."""
        known = {k: v for k, v in settings.items() if k in self.__dataclass_fields__ and k != "channels"}
        if "exclude" in known:
            known["exclude"] = (*self.exclude, *known["exclude"])  # excludes add up
        out = replace(self, **known)
        return replace(out, channels=parse_mode(settings["mode"])) if "mode" in settings else out


def parse_mode(mode: str) -> tuple[tuple[str, float | None], ...]:
    """`exact,near:0.7` as channels and thresholds. A channel counts once."""
    out: dict[str, float | None] = {}
    for part in mode.split(","):
        name, colon, value = part.strip().partition(":")
        if name not in CHANNELS:
            raise ValueError(f"unknown channel {name}: one of {', '.join(CHANNELS)}")
        if colon and CHANNELS[name] is None:
            raise ValueError(f"{name} takes no threshold")
        try:
            at = float(value) if colon else CHANNELS[name]
        except ValueError:
            raise ValueError(f"{part}: not a number") from None
        if at is not None and not 0 < at <= 1:
            raise ValueError(f"{part}: a threshold lies above 0 and up to 1")
        out[name] = at
    return tuple(out.items())


class Detector(Protocol):
    """A channel: pairs of units with a score."""

    name: str

    def pairs(self, units: DataFrame) -> DataFrame:
        """(a, b, score) with a < b of units (id, norm)."""


class Exact:
    """Equal texts: every copy with the first of its class."""

    name = "exact"

    def pairs(self, units: DataFrame) -> DataFrame:
        from .operators.similarity import classes

        return classes(units, "id", F.col("norm")).filter("id <> class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))


class Near:
    """Texts whose word shingles are alike, between the firsts of their classes."""

    name = "near"

    def __init__(self, threshold: float = 0.8):
        self.threshold = threshold

    def pairs(self, units: DataFrame) -> DataFrame:
        from .operators import similarity as S
        from .operators.scale import cut

        cls = cut(S.classes(units, "id", F.col("norm")))
        sets = S.word_shingles(S.representatives(cls, units, "id", F.col("norm")), quick=True)
        return S.jaccard_links(sets, self.threshold).select("a", "b", F.col("jaccard").alias("score"))


def detectors(options: Options) -> list[Detector]:
    made = {"exact": lambda t: Exact(), "near": lambda t: Near(t or 0.8)}
    return [made[name](at) for name, at in options.channels if name in made]


def combine(channels: list[Detector], units: DataFrame) -> DataFrame:
    """(a, b, score, channel, channels): the pairs of all channels, each with its best
    score, the channel that gave it, and how many found it. Of equal scores the first
    channel by name counts."""
    every = reduce(DataFrame.unionByName, [c.pairs(units).withColumn("channel", F.lit(c.name)) for c in channels])
    best = F.min(F.struct((-F.col("score")).alias("s"), "channel"))
    g = every.groupBy("a", "b").agg(best.alias("m"), F.count_distinct("channel").alias("channels"))
    return g.select("a", "b", (-F.col("m.s")).alias("score"), F.col("m.channel").alias("channel"), "channels")
