"""T1 in update mode with S3: incidents that change while their window is open.

The windowed aggregate runs in update mode: a micro-batch emits every (window,
element) that new alarms have changed, with all its alarms so far.  The sink upserts
these incidents on incident_ref into a stored table, as one commit keyed by (writer,
batch id): only the dates of changed windows are rewritten, and a batch that is
repeated after a crash changes nothing.  A restarted job goes on from its state and
its commits, so its table equals that of an unbroken run.

The engine's aggregate is used rather than a Python stateful processor: alarms of one
element are combined on the tasks that read them, so a burst on one element stays
a few partial rows.  Its state is one fixed-width row per open window; the
watermark removes it and drops later alarms.  Session windows know no update mode in
the engine; they are emitted once, by `correlate`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_DOMAIN, DEFAULT_TUNING, Domain, Tuning
from ..operators.common import stored
from ..sources.store import Store
from ..sources.tables import upsert_into
from .correlate import incidents_from_windows, window_aggregate

WRITER = "stream_incidents"


def stream_incidents(stream: DataFrame, base: str, checkpoint: str, *, size: str = "15 minutes", watermark: str = "10 minutes",
                     min_alarms: int = 5, tuning: Tuning = DEFAULT_TUNING, domain: Domain = DEFAULT_DOMAIN,
                     writer: str = WRITER, available_now: bool = True):
    """Start the job; `base` is the stored incident table.  A new incident is open; a known
    one keeps its status."""
    changed = incidents_from_windows(window_aggregate(stream, size=size, watermark=watermark, domain=domain), min_alarms, tuning, domain)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, base)
        if store.done(writer, batch_id):
            return
        rows = stored(batch.withColumn("status", F.lit("open")), "stream-incidents")       # read several times
        if rows.isEmpty():
            return
        known = [c for c in rows.columns if c not in ("incident_ref", "element_id", "window_start", "window_end", "status")]
        upsert_into(store, rows, ["incident_ref"], known, "window_start", writer, batch_id)

    w = changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
