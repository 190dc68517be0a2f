"""A raster cache without MERGE: an append-only log of writes and a view of the latest state per key."""

from __future__ import annotations

import time
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of which a later write without a value keeps the earlier one.
KEPT = ["ndvi_metadata", "season_from", "season_to", "cloud_cover_pct", "ndvi_mean_at_selection", "candidates_considered"]
REQUEST = ["width", "height", "max_cloud_cover", "time_from", "time_to", "mosaicking_order"]
BBOX = ["min_x", "min_y", "max_x", "max_y"]


def rounded_key(log: DataFrame) -> DataFrame:
    """Boxes to 6 digits and cloud limits to 1, stored, so that lookups push plain equalities down to the files."""
    cols = {c: F.round(c, 6) for c in BBOX if c in log.columns}
    if "max_cloud_cover" in log.columns:
        cols["max_cloud_cover"] = F.round("max_cloud_cover", 1)
    return log.withColumns(cols)


def cache_key(log: DataFrame) -> list[Column]:
    """The field and request, or for requests without a field the box and request."""
    box = [F.when(F.col("field_id").isNull(), F.col(c)) for c in BBOX if c in log.columns]
    return [F.col("field_id"), *box, *(F.col(c) for c in REQUEST if c in log.columns)]


def latest(log: DataFrame, keys: list[str], version: str, kept: list[str]) -> DataFrame:
    """The latest write per key; of the ``kept`` columns the latest value that is not null."""
    rest = [c for c in log.columns if c not in (*keys, *kept)]
    last = F.max_by(F.struct(*rest), F.col(version)).alias("s")
    # max_by over a null-guarded order keeps the last known value
    known = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in kept]
    return log.groupBy(*keys).agg(last, *known).select(*keys, "s.*", *kept)


def upsert(log: DataFrame, version: str = "id") -> DataFrame:
    """The cache's state after all writes in the log."""
    keyed = log.select(*(c.alias(f"_k{i}") for i, c in enumerate(cache_key(log))), "*")
    keys = [c for c in keyed.columns if c.startswith("_k")]
    return latest(keyed, keys, version, [c for c in KEPT if c in log.columns]).drop(*keys)


def live(state: DataFrame, now: Column) -> DataFrame:
    return state.filter(F.col("expires_at") > now)


def lookup(state: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Requests left-joined to live entries: by field with an unchanged box, else by box. A moved outline is a miss."""
    on = [c for c in (*BBOX, *REQUEST) if c in requests.columns and c in state.columns]
    same = [F.col(f"q.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("field_id", *on)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    found = requests.alias("q").join(live(state, now).alias("s"), cond, "left")
    rest = [F.col(f"s.{c}") for c in state.columns if c not in requests.columns]
    return found.select(*(F.col(f"q.{c}") for c in requests.columns), *rest, F.col("s.expires_at").isNotNull().alias("hit"))


class Transient:
    """Persisted tables of a session by key, for some seconds: asked for later they are gone and made anew. What has
    expired is released when anything is asked for; with no seconds nothing is kept."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock = seconds, clock
        self.held: dict[Hashable, tuple[float, DataFrame]] = {}

    def get(self, key: Hashable) -> DataFrame | None:
        now = self.clock()
        for k in [k for k, (until, _) in self.held.items() if now > until]:
            self.held.pop(k)[1].unpersist()
        return self.held[key][1] if key in self.held else None

    def put(self, key: Hashable, table: DataFrame) -> DataFrame:
        self.drop(key)
        if self.seconds > 0:
            self.held[key] = self.clock() + self.seconds, table.persist()
        return table

    def drop(self, key: Hashable) -> None:
        if key in self.held:
            self.held.pop(key)[1].unpersist()

    def through(self, key: Hashable, make: Callable[[], DataFrame]) -> DataFrame:
        """What is held under the key, else what is made, which is then held."""
        found = self.get(key)
        return self.put(key, make()) if found is None else found
