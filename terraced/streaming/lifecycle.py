"""The lifecycle fold over a stream of change events, with all keys kept or with state that ends."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraced.operators.reconcile import lifecycle_fold
from terraced.session import folder_exists, scratch_path


def read_event_stream(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """Parquet files under ``path`` (a folder or glob) as an unbounded table."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def fold_stream(events: DataFrame, key: str, folder: str | None = None) -> DataFrame:
    """Fold all events available now and return the resulting state per key.

    The aggregate keeps one row of state per key and is insensitive to repeats
    and to arrival order, so neither a watermark nor an event-id store is needed.
    Each micro-batch writes its changed keys to a folder named after the batch; a
    repeated batch replaces its own folder, so a restart leaves no duplicates.
    Run again with the same ``folder`` to continue from where it stopped.
    """
    spark = events.sparkSession
    folder = folder or scratch_path(spark, "lifecycle")
    changes = f"{folder}/changes"

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={batch_id}")

    folded = lifecycle_fold(events, key)
    query = (
        folded.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    if not folder_exists(spark, changes):  # nothing has arrived yet
        latest = [f for f in folded.schema.fields if f.name in (key, "ts", "event_id", "action")]
        return spark.createDataFrame([], T.StructType(latest)).select(key, "ts", "event_id", "action")
    state = spark.read.schema(T.StructType([*folded.schema.fields, T.StructField("batch", T.LongType())])).parquet(changes)
    latest = F.max_by(F.struct("ts", "event_id", "action"), "batch").alias("latest")
    return state.groupBy(key).agg(latest).select(key, "latest.ts", "latest.event_id", "latest.action")


@dataclass(frozen=True)
class Run:
    """A stored fold of some batches: its folder, its level and its rows."""

    name: str
    level: int
    rows: int


@dataclass(frozen=True)
class Record:
    """What a state consists of after a batch. ``latest`` is the newest event time seen."""

    batch: int = -1
    latest: datetime | None = None
    runs: tuple[Run, ...] = ()


class EndingState:
    """Last action per key under ``folder``, without keys that were destroyed long ago.

    Every micro-batch is folded and stored as a run. ``fanout`` runs of one level are
    folded into one of the next, and all runs into one as soon as the newer ones
    hold as many rows as the oldest, so after N batches there are O(fanout * log N)
    runs and a row is rewritten O(log N) times. Nothing is kept in executors
    between batches.

    Events older than the horizon, the newest event time of earlier batches less
    ``lateness``, are dropped on arrival. So a destroyed key whose last event is
    older can't come back and is forgotten: at once for readers, on disk by the next fold
    of all runs. Events without a time are dropped; a null key is a key.

    A record per batch names the runs. A batch that was recorded before the stream could
    commit it is not applied again; one that was cut off earlier replaces its own
    folders. Runs that neither of the two newest records names are deleted, so a frame
    from ``read`` holds for one further batch.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, lateness: timedelta, fanout: int = 4) -> None:
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.folder, self.key, self.lateness, self.fanout = spark, folder.rstrip("/"), key, lateness, fanout

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Fold one micro-batch (``key, ts, event_id, action``) into the state."""
        record = self.record()
        if batch_id <= record.batch:
            return
        usable = batch.filter("ts IS NOT NULL")
        if record.latest:
            usable = usable.filter(self._since_horizon(usable, record))
        run, latest = self._store(lifecycle_fold(usable, self.key), f"{batch_id}-0", 0)
        newest = max((t for t in (record.latest, latest) if t), default=None)
        after = Record(batch_id, newest, record.runs + ((run,) if run.rows else ()))
        after = self._folded(after)
        self._write(after)
        self._clean({r.name for r in record.runs + after.runs}, {record.batch, batch_id})

    def read(self) -> DataFrame:
        """The state after the newest batch; fails on a folder without any."""
        record = self.record()
        return self._without_ended(lifecycle_fold(self._rows(record.runs), self.key), record)

    def horizon(self, record: Record) -> datetime | None:
        return record.latest - self.lateness if record.latest else None

    def record(self) -> Record:
        """The newest record, or an empty one."""
        numbers = self._records()
        if not numbers:
            return Record()
        text = self.spark.read.text(self._record_path(max(numbers)), wholetext=True).head()[0]
        stored = json.loads(text)
        latest = datetime.fromisoformat(stored["latest"]) if stored["latest"] else None
        return Record(stored["batch"], latest, tuple(Run(**run) for run in stored["runs"]))

    def _folded(self, record: Record) -> Record:
        """Fold runs until no level holds ``fanout`` of them and the oldest run is the largest part."""
        while True:
            runs = record.runs
            crowded = [level for level in {r.level for r in runs} if sum(r.level == level for r in runs) >= self.fanout]
            if len(runs) > 1 and sum(r.rows for r in runs[1:]) >= runs[0].rows:
                chosen = runs
            elif crowded:
                chosen = tuple(r for r in runs if r.level == min(crowded))
            else:
                return record
            merged = lifecycle_fold(self._rows(chosen), self.key)
            if chosen == runs:  # only now no older fact is left that a forgotten tombstone would have covered
                merged = self._without_ended(merged, record)
            level = max(r.level for r in chosen) + 1
            run, _ = self._store(merged, f"{record.batch}-{level}", level)
            place = runs.index(chosen[0])
            left = [r for r in runs if r not in chosen]
            record = replace(record, runs=tuple(left[:place] + [run] * bool(run.rows) + left[place:]))

    def _without_ended(self, state: DataFrame, record: Record) -> DataFrame:
        return state.filter((F.col("action") != "destroy") | self._since_horizon(state, record)) if record.latest else state

    def _since_horizon(self, rows: DataFrame, record: Record) -> Column:
        """Compared as text of the session's zone, whatever the driver's own zone is."""
        return F.col("ts") >= F.lit(self.horizon(record).isoformat(" ")).cast(rows.schema["ts"].dataType)

    def _store(self, rows: DataFrame, name: str, level: int) -> tuple[Run, datetime | None]:
        """Write a run; the write itself counts its rows and finds its newest time."""
        seen = Observation()
        counted = rows.observe(seen, F.count("*").alias("rows"), F.max("ts").cast("timestamp_ntz").alias("latest"))
        counted.write.mode("overwrite").parquet(f"{self.folder}/runs/{name}")
        return Run(name, level, seen.get["rows"]), seen.get["latest"]

    def _rows(self, runs: tuple[Run, ...]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/runs/{r.name}" for r in runs])

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _record_path(self, number: int) -> str:
        return f"{self.folder}/records/{number}.json"

    def _records(self) -> list[int]:
        found = self._system().globStatus(self._path(f"{self.folder}/records/*.json")) or []
        return [int(status.getPath().getName().removesuffix(".json")) for status in found]

    def _write(self, record: Record) -> None:
        """A record appears as a whole: it is written aside and then named."""
        system, aside = self._system(), self._path(f"{self.folder}/records/{record.batch}.part")
        out = system.create(aside, True)
        try:
            out.write(bytearray(json.dumps(asdict(record), default=datetime.isoformat).encode()))
        finally:
            out.close()
        if not system.rename(aside, self._path(self._record_path(record.batch))):
            raise OSError(f"record {record.batch} was not written")

    def _clean(self, runs: set[str], records: set[int]) -> None:
        system = self._system()
        for status in system.globStatus(self._path(f"{self.folder}/runs/*")) or []:
            if status.getPath().getName() not in runs:
                system.delete(status.getPath(), True)
        for number in set(self._records()) - records:
            system.delete(self._path(self._record_path(number)), False)


def fold_ending_stream(
    events: DataFrame, key: str, folder: str, lateness: timedelta, fanout: int = 4
) -> DataFrame:
    """Fold all events available now into an ``EndingState`` and return it; run again to continue.

    The stream itself is stateless, so no key stays in a state store. An empty
    stream leaves an empty state.
    """
    state = EndingState(events.sparkSession, folder, key, lateness, fanout)
    query = (
        events.writeStream.option("checkpointLocation", f"{state.folder}/progress")
        .trigger(availableNow=True)
        .foreachBatch(state.apply)
        .start()
    )
    query.awaitTermination()
    if state.record().runs:
        return state.read()
    kept = {f.name: f for f in events.schema.fields}
    return state.spark.createDataFrame([], T.StructType([kept[c] for c in (key, "ts", "event_id", "action")]))
