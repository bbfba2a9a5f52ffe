"""Which evaluations are active, kept up to date over a stream of events: keyed state instead of the whole log.

Events (kind PRE, POST, INVALIDATE or CONTEXT) belong to a subject and a model. Only the latest PRE and the latest POST of a key can be
active, so the state of a key is those two, the ids taken back, and the time from which its context holds. Events may come late and in any
order: the state after a batch is that of the whole log so far (``evaluate.with_activity``), also after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from draftlake.session import ship

EVENT = "kind string, subject_id string, model_id string, evaluation_id string, parent_id string, created_at timestamp"
CHANGE = "subject_id string, model_id string, seq long, phase string, evaluation_id string, is_active boolean"
NAMES = [c.split()[0] for c in CHANGE.split(", ")]


class Activity(StatefulProcessor):
    """Rows of what has become active or no longer is, numbered by key. ``idle_ms``: a key without events for so long is closed, and its evaluations with it."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # latest PRE and POST (id, time in microseconds), the POST's parent, the time of the context, what is shown as active, changes so far
        self.state = handle.getValueState("state", "pre string, pre_at long, post string, post_at long, parent string, since long, shown_pre string, shown_post string, seq long")
        self.gone = handle.getMapState("gone", "evaluation_id string", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # each call of the state is a message to the JVM and back, so there are as few as may be
        pre, pre_at, post, post_at, parent, since, shown_pre, shown_post, seq = self.state.get() or (None, None, None, None, None, None, None, None, 0)
        fresh = {}
        for e in rows:
            kind, i, at = e.kind, e.evaluation_id, e.at
            if kind == "INVALIDATE":
                fresh[i] = at
            elif kind == "CONTEXT":
                since = at if since is None else max(since, at)
            elif kind == "PRE" and (pre is None or (at, i) > (pre_at, pre)):
                pre, pre_at = i, at
            elif kind == "POST" and (post is None or (at, i) > (post_at, post)):
                post, post_at, parent = i, at, e.parent_id
        for i, at in fresh.items():
            self.gone.updateValue((i,), (at,))
        # what was shown had not been taken back before
        holds = lambda i, at, shown: i is not None and (since is None or at >= since) and i not in fresh and (i == shown or not self.gone.containsKey((i,)))
        now_pre = pre if holds(pre, pre_at, shown_pre) else None
        now_post = post if now_pre is not None and parent == now_pre and holds(post, post_at, shown_post) else None
        changes = []
        for phase, old, new in (("PRE", shown_pre, now_pre), ("POST", shown_post, now_post)):
            if old != new:
                changes += [(phase, i, active) for i, active in ((old, False), (new, True)) if i is not None]
        out = [(*key, seq + n, *c) for n, c in enumerate(changes)]
        self.state.update((pre, pre_at, post, post_at, parent, since, now_pre, now_post, seq + len(out)))
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from (Row(**dict(zip(NAMES, c, strict=True))) for c in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *_, shown_pre, shown_post, seq = self.state.get()
        out = [(*key, seq + n, phase, i, False) for n, (phase, i) in enumerate(x for x in (("PRE", shown_pre), ("POST", shown_post)) if x[1] is not None)]
        self.state.clear()
        self.gone.clear()
        yield from (Row(**dict(zip(NAMES, c, strict=True))) for c in out)

    def close(self) -> None:
        pass


def changes(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of EVENT rows as a stream of CHANGE rows."""
    at = F.coalesce(F.unix_micros("created_at"), F.lit(0).cast("long")).alias("at")
    keyed = events.select("kind", "subject_id", "model_id", "evaluation_id", "parent_id", at).groupBy("subject_id", "model_id")
    return keyed.transformWithState(Activity(idle_ms), CHANGE, "Append", "None" if idle_ms is None else "ProcessingTime")


def start(spark: SparkSession, events: DataFrame, path: str, checkpoint: str, idle_ms: int | None = None):
    """Append the changes of a stream to ``path`` and stop when it has caught up; state is kept in RocksDB, its snapshots at the checkpoint."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return changes(events, idle_ms).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def active(found: DataFrame) -> DataFrame:
    """(subject_id, model_id, phase, evaluation_id) that are active after all CHANGE rows so far."""
    last = Window.partitionBy("subject_id", "model_id", "evaluation_id").orderBy(F.desc("seq"))
    return found.withColumn("n__", F.row_number().over(last)).where("n__ = 1 AND is_active").select("subject_id", "model_id", "phase", "evaluation_id")
