"""Status of shows as keyed state: events move it only along allowed transitions.

The state of a show (status, events, refused events) lives in Spark's state store, in RocksDB,
so it is neither read again from old batches nor held on the heap.  It starts from the
show's stored status.  Inside a batch, events of a show are taken in the order of (ts, event_id); an
event that is not allowed from the status reached so far changes nothing and goes to the side output.  A state
that got no event for ``ttl`` expires; its show starts from no status again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stallworks import rules
from stallworks.session import cut_lineage
from stallworks.streaming.store import Change, Layout, StateStore

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOVES = "show_id long, event_id long, ts timestamp, new_status string, allowed boolean, status string, events long, refused long"
STATUS = Layout("show_id bigint, status string, events bigint, refused bigint, changed_at timestamp", "show_id", "show_id")


def moves(events: DataFrame, initial: DataFrame, allowed: list[tuple[str, str]] | None = None, ttl: str | None = None) -> DataFrame:
    """Every event of (show_id, event_id, ts, new_status) with the status its show has after it.

    ``initial``: (show_id, status); ``allowed``: moves, by default those of a campaign.
    """
    pairs = frozenset(tuple(pair) for pair in (rules.TRANSITIONS if allowed is None else allowed))
    millis = None if ttl is None else int(events.sparkSession.sql(f"SELECT extract(epoch FROM INTERVAL {ttl})").first()[0] * 1000)

    # a class of this call travels to the tasks with the job
    class Guard(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.held = handle.getValueState("held", "status string, events long, refused long", millis)

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self.held.update((initialState.status, 0, 0))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            rows = sorted(rows, key=lambda r: (r.ts, r.event_id))
            status, events, refused = self.held.get() if self.held.exists() else (getattr(rows[0], "stored", None), 0, 0)
            for row in rows:
                good = (status, row.new_status) in pairs
                status, events, refused = (row.new_status if good else status), events + 1, refused + (not good)
                yield Row(show_id=key[0], event_id=row.event_id, ts=row.ts, new_status=row.new_status, allowed=good, status=status,
                          events=events, refused=refused)
            self.held.update((status, events, refused))

        def close(self) -> None:
            pass

    if millis is None:  # the stored status comes with the events, so only shows that have some get a state
        stored = initial.groupBy(F.col("show_id").alias("stored_id")).agg(F.max("status").alias("stored")).hint("merge")
        known = events.join(stored, F.col("show_id").eqNullSafe(F.col("stored_id")), "left").drop("stored_id")
        return known.groupBy("show_id").transformWithState(
            statefulProcessor=Guard(), outputStructType=MOVES, outputMode="Update", timeMode="None")
    # an expired state must not start from the stored status again, so here every show has its state from the beginning
    return events.groupBy("show_id").transformWithState(
        statefulProcessor=Guard(), outputStructType=MOVES, outputMode="Update", timeMode="ProcessingTime",
        initialState=initial.select("show_id", "status").groupBy("show_id"))


def status_store(spark: SparkSession, path: str, slots: int = 16, buckets: int = 8) -> StateStore:
    store = StateStore(spark, path, {"status": STATUS}, slots, buckets)
    store.create(status=spark.createDataFrame([], STATUS.columns))
    return store


def stream_guarded_status(
    events: DataFrame, initial: DataFrame, store: StateStore, refused: str, checkpoint: str, seconds: int | None = None, ttl: str | None = None,
) -> StreamingQuery:
    """Keeps the status of every show that had an event in ``store``; refused events go to ``refused``, one folder per batch.

    A repeated batch finds its commit done and replaces its own folder.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def batch(rows: DataFrame, number: int) -> None:
        held = cut_lineage(rows)
        last = held.groupBy("show_id").agg(F.max_by(F.struct("status", "events", "refused", F.col("ts").alias("changed_at")), "events").alias("r"))
        store.commit("status", number, lambda state: {"status": Change(last.select("show_id", "r.*"))})
        held.filter("NOT allowed").select("show_id", "event_id", "ts", "new_status", "status").write.mode("overwrite").parquet(f"{refused}/batch={number}")

    writer = moves(events, initial, ttl=ttl).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()
