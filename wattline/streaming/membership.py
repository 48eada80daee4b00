"""The last snapshots of each cluster's members as streaming state, with their stability."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that list state with a time to live needs; set on the session before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _History(StatefulProcessor):
    """Keeps ``keep`` snapshots (time, members) of a cluster in order of time, the newest last."""

    def __init__(self, keep: int, ttl_ms: int | None) -> None:
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("snapshots", "snapshot timestamp, members array<bigint>", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = {t: set(m) for t, m in self.rows.get()} if self.rows.exists() else {}
        for part in rows:
            part = part.dropna(subset=["snapshot", "building_id"])
            for t, m in part.groupby("snapshot")["building_id"]:
                held.setdefault(t.to_pydatetime(), set()).update(int(x) for x in m)
        times = sorted(held)[-self.keep :]
        if not times:
            return
        self.rows.put([(t, sorted(held[t])) for t in times])
        steps = [len(held[a] & held[b]) / len(held[a] | held[b]) for a, b in zip(times, times[1:], strict=False)]
        yield pd.DataFrame({"cluster_id": [key[0]], "newest": [times[-1]], "snapshots": [len(times)], "members": [len(held[times[-1]])], "stability": [sum(steps) / len(steps) if steps else None]})

    def close(self) -> None:
        pass


def membership_history(memberships: DataFrame, keep: int = 10, ttl_hours: float | None = None) -> DataFrame:
    """(cluster_id, newest, snapshots, members, stability) in update mode: after each batch, over the last ``keep`` snapshots that a cluster was seen in.

    memberships is a stream of cluster_id, snapshot (timestamp), building_id; a snapshot's rows may come in any order and in several
    batches, a repeated row counts once, and snapshots older than the ones kept are forgotten. stability is the mean Jaccard
    index of neighbouring snapshots, null with one. A cluster from which nothing comes for ``ttl_hours`` of processing time
    is dropped by the store itself. State is ``keep`` sets of one cluster's members a key, kept in the checkpoint, so a restart goes on
    with them. Rows with a null cluster are a cluster of their own; with a null snapshot or building they are left out.
    """
    m = memberships.selectExpr("cast(cluster_id AS long) AS cluster_id", "cast(snapshot AS timestamp) AS snapshot", "cast(building_id AS long) AS building_id")
    ttl = None if ttl_hours is None else int(ttl_hours * 3_600_000)
    return m.groupBy("cluster_id").transformWithStateInPandas(_History(keep, ttl), "cluster_id long, newest timestamp, snapshots long, members long, stability double", "Update", "ProcessingTime" if ttl else "None")
