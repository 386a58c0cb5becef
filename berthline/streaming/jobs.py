"""Continuous versions of intake, placement, counters and utilisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from berthline.plans.placement import PlacementRules, place_snapshot
from berthline.schemas import SCHEDULED
from berthline.session import store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State groups of the release state, each with tasks of all machines.
STATE_SHARDS = 64
#: Finish times that share an entry of the release state.
RELEASE_BUCKET_MS = 7 * 86_400_000
#: Arriving rows of a group that are filed at a time, or up to a batch more.
RELEASE_ROWS = 1_000_000
#: Finish times that share a folder of a stored ledger.
LEDGER_DAY_MS = 86_400_000
#: Files of one such folder, at most for each write.
LEDGER_FILES = 8

RELEASE_SCHEMA = T.StructType(
    [
        T.StructField("machine_id", T.LongType()),
        T.StructField("task_id", T.LongType()),
        T.StructField("released_ms", T.LongType()),
    ]
)


def start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
          available_now: bool = True) -> StreamingQuery:
    """Run ``batch`` on every micro-batch; by default until the input is used up."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder, so that a repeated batch replaces itself."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def read_appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches of ``append_to``."""
    return spark.read.schema(schema).option("basePath", path).parquet(path).select(*schema.fieldNames())


def read_newest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The newest row per key among the batches of an update-mode query."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(with_batch).option("basePath", path).parquet(path)
    values = [f.name for f in schema.fields if f.name not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in values])


def write_ledger(allocations: DataFrame, path: str, part_ms: int = LEDGER_DAY_MS, mode: str = "errorifexists") -> str:
    """Allocations in folders by the time at which they finish, so that what is over is never read again."""
    parted = allocations.withColumn("finish_part", F.expr(f"finish_ms div {part_ms}"))
    # a few files a folder, also where one period holds most rows
    dealt = parted.repartition("finish_part", F.pmod(F.xxhash64("task_id"), F.lit(LEDGER_FILES)))
    dealt.write.mode(mode).partitionBy("finish_part").parquet(path)
    return path


def read_active(spark: SparkSession, path: str, first_ms: int, last_ms: int, part_ms: int = LEDGER_DAY_MS) -> DataFrame:
    """The allocations of a stored ledger that are active at some time from ``first_ms`` to ``last_ms``.

    Folders of periods that end before are pruned, files that start after are skipped by their statistics.
    """
    rows = spark.read.parquet(path).filter(F.col("finish_part") >= F.lit(first_ms // part_ms))
    return rows.filter((F.col("start_ms") <= F.lit(last_ms)) & (F.col("finish_ms") > F.lit(first_ms))).drop("finish_part")


def place_stream(
    tasks: DataFrame, machines: DataFrame, allocations: Callable[[], DataFrame] | Callable[[int, int], DataFrame], scorer,
    rules: PlacementRules, path: str, checkpoint: str, available_now: bool = True, ranged: bool = False,
) -> StreamingQuery:
    """Place arriving tasks against the pool and the ledger as it is when their batch starts.

    A batch is stored once and reads the allocations that are active at some time between its first
    and its last arrival; no others matter for it. With ``ranged``, ``allocations`` is
    called with these two times (see ``read_active``); otherwise it gives the whole ledger.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = store(df, "stream-batch")
        first, last = rows.agg(F.min("arrival_ms"), F.max("arrival_ms")).first()
        if first is None:  # no task, or none that tells when it arrives
            first, last = 0, -1
        known = allocations(first, last) if ranged else allocations()
        active = known.filter((F.col("start_ms") <= F.lit(last)) & (F.col("finish_ms") > F.lit(first)))
        placed = place_snapshot(rows, machines, active, scorer, rules)
        placed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return start(tasks, batch, checkpoint, available_now=available_now)


def live_kpis(placements: DataFrame) -> DataFrame:
    """Running counters per status (update mode)."""
    return placements.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.col("status") == SCHEDULED).alias("n_scheduled")
    )


def utilization_windows(
    samples: DataFrame, time: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes",
) -> DataFrame:
    """Mean and peak utilisation per machine and time window, of every resource that the samples have.

    Rows later than ``late`` are dropped.
    """
    window = F.window(time, width, slide) if slide else F.window(time, width)
    values = {
        f"{how}_{r}": fn(f"{r}_util") for r in ("cpu", "gpu", "ram") if f"{r}_util" in samples.columns
        for how, fn in (("avg", F.avg), ("max", F.max))
    }
    return (
        samples.withWatermark(time, late)
        .groupBy(window.alias("w"), "machine_id")
        .agg(F.count(F.lit(1)).alias("n"), *[v.alias(n) for n, v in values.items()])
        .select("machine_id", F.col("w.start").alias("window_start"), "n", *values)
    )


def live_latest(samples: DataFrame, time: str = "ts", values: tuple[str, ...] = ("cpu_util",)) -> DataFrame:
    """Newest sample per machine (update mode); of several at one time, the one with the largest values."""
    last = F.max(F.struct(time, *values)).alias("_last")
    return samples.groupBy("machine_id").agg(last).select(
        "machine_id", *[F.col(f"_last.{c}").alias(c) for c in (time, *values)]
    )


class ReleaseProcessor(StatefulProcessor):
    """Holds active tasks and reports every one when its finish time has passed.

    Tasks lie in a map from buckets of finish times to the tasks that finish in them, with an
    event-time timer for the earliest finish of each bucket. A wake-up reads and writes its own bucket
    only, however many tasks are active. A task whose finish is already behind the
    watermark is released at once. A group may hold tasks of many machines; rows that do
    not name theirs belong to the machine that is the group's key.
    """

    def __init__(self, bucket_ms: int = RELEASE_BUCKET_MS) -> None:
        self.bucket_ms = bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getMapState(
            "active", "bucket long", "finish_ms array<long>, task_id array<long>, machine_id array<long>"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for arrived in self._gathered(key, rows):
            over = arrived["finish_ms"] <= now
            if over.any():
                gone = arrived[over]
                yield self._released(gone["finish_ms"].tolist(), gone["task_id"].tolist(), gone["machine_id"].tolist())
            held = arrived[~over]
            for bucket, tasks in held.groupby(held["finish_ms"] // self.bucket_ms):
                finishes, ids, machines = self._held(int(bucket))
                first = int(tasks["finish_ms"].min())
                if not finishes or first < min(finishes):
                    self.handle.registerTimer(first)
                self.active.updateValue((int(bucket),), (
                    finishes + tasks["finish_ms"].tolist(), ids + tasks["task_id"].tolist(), machines + tasks["machine_id"].tolist(),
                ))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        now, bucket = max(timerValues.getCurrentWatermarkInMs(), due), due // self.bucket_ms
        held = list(zip(*self._held(bucket)))
        if not held:
            return
        rest = [task for task in held if task[0] > now]
        gone = [task for task in held if task[0] <= now]
        if rest:
            self.active.updateValue((bucket,), tuple(map(list, zip(*rest))))
            self.handle.registerTimer(min(rest)[0])
        else:
            self.active.removeKey((bucket,))
        if gone:
            yield self._released(*zip(*gone))

    def _gathered(self, key, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The batches in portions, so that a bucket is not rewritten for every batch."""
        waiting, n = [], 0
        for batch in rows:
            if "machine_id" not in batch.columns:
                batch = batch.assign(machine_id=int(key[0]))
            waiting.append(batch[["finish_ms", "task_id", "machine_id"]])
            n += len(batch)
            if n >= RELEASE_ROWS:
                yield pd.concat(waiting, ignore_index=True)
                waiting, n = [], 0
        if waiting:
            yield pd.concat(waiting, ignore_index=True)

    def _held(self, bucket: int) -> tuple[list[int], list[int], list[int]]:
        found = self.active.getValue((bucket,)) if self.active.containsKey((bucket,)) else None
        return tuple([int(v) for v in values] for values in found) if found is not None else ([], [], [])

    def _released(self, finishes: list[int], ids: list[int], machines: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"machine_id": machines, "task_id": ids, "released_ms": finishes})

    def close(self) -> None:
        pass


def occupancy_state(
    allocations: DataFrame, late: str = "10 minutes", shards: int = STATE_SHARDS, bucket_ms: int = RELEASE_BUCKET_MS
) -> DataFrame:
    """Release events of a stream of allocations (machine_id, task_id, start timestamp, finish_ms).

    Releases do not depend on each other, so tasks are dealt out over ``shards`` state groups
    by a hash. A group holds tasks of all machines: its entries and timers are as many as its buckets
    of time, however many tasks and machines there are. Allocations that
    start more than ``late`` before the newest one seen are dropped. Needs the RocksDB
    state store: ``spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)``.
    """
    return (
        allocations.withColumn("shard", F.pmod(F.xxhash64("machine_id", "task_id"), F.lit(shards)).cast("int"))
        .withWatermark("start", late)
        .groupBy("shard")
        .transformWithStateInPandas(
            statefulProcessor=ReleaseProcessor(bucket_ms), outputStructType=RELEASE_SCHEMA, outputMode="Append",
            timeMode="EventTime",
        )
    )
