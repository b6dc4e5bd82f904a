"""The whole analysis of a log: one set of entries, all statistics and incidents on it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .. import stored
from ..operators import aggregates as A, behavior as B, matches, parse, path_rules, rules, scoring
from ..thresholds import DEFAULT, Thresholds


@dataclass
class Analysis:
    """Results over `entries`.  What several results read - the entries, rule hits, statistics of clients, agents, bots
    and paths, and the scored incidents - is written once to the shared folder at first use, so that plans stay small and
    nothing is parsed twice; `stored.release` deletes it."""

    entries: DataFrame
    thresholds: Thresholds = DEFAULT
    ranges: B.Ranges = field(default_factory=B.Ranges)
    strict_gate: bool = True

    def __post_init__(self):
        self._made: dict = {}
        self.entries = stored.keep(self.entries, "entries")

    def _once(self, name, make, keep: bool = False) -> DataFrame:
        if name not in self._made:
            df = make()
            self._made[name] = stored.keep(df, name) if keep else df
        return self._made[name]

    @property
    def log(self) -> DataFrame:
        return self._once("log", lambda: parse.access_log(self.entries))

    @property
    def hits(self) -> DataFrame:
        return self._once("hits", lambda: rules.rule_hits(self.entries, self.strict_gate), True)

    @property
    def profiles(self) -> DataFrame:
        return self._once("profiles", lambda: A.ip_profiles(self.entries, self.thresholds), True)

    @property
    def actors(self) -> DataFrame:
        return self._once("actors", lambda: A.known_actors(self.entries), True)

    @property
    def crawlers(self) -> DataFrame:
        return self._once("crawlers", lambda: self.ranges.crawlers(self.profiles.select("ip")), True)

    @property
    def bots(self) -> DataFrame:
        return self._once("bots", lambda: A.bot_rollup(self.entries, self.actors, self.thresholds), True)

    @property
    def path_stats(self) -> DataFrame:
        return self._once("path_stats", lambda: A.path_stats(self.entries, self.thresholds, samples=True), True)

    @property
    def time_stats(self) -> DataFrame:
        return self._once("time_stats", lambda: A.time_stats(self.entries, self.thresholds))

    def top(self, what: str, k: int = 20) -> DataFrame:
        return A.top_of(self.entries, what, k)

    @property
    def scored(self) -> DataFrame:
        """All incidents, scored, with the facts that the bridge needs."""

        def make():
            found = rules.rule_incidents(self.hits).unionByName(path_rules.path_incidents(self.path_stats, self.thresholds))
            return scoring.scored(found.unionByName(B.behavior_incidents(self.entries, self.profiles, self.actors, self.bots, self.crawlers, self.thresholds)))

        return self._once("scored", make, True)

    def incidents(self, kind: str | None = None) -> DataFrame:
        """Incidents in report order, of one kind or all."""
        df = scoring.public(self.scored)
        return scoring.ordered(df if kind is None else df.filter(df["kind"] == kind))

    @property
    def bridge(self) -> DataFrame:
        """id, row of every incident."""
        return self._once("bridge", lambda: matches.incident_rows(self.entries, self.hits, self.scored), True)

    def match_samples(self, most: int = 200) -> DataFrame:
        return matches.match_samples(self.bridge, most)
