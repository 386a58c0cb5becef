"""Who is busy when: interval questions answered without interval joins.

An allocation holds its machine on [start, finish). Running totals of starts and finishes
give usage at any instant; power-of-two blocks of the time line ("cover blocks") turn
"which intervals contain t" into an equi-join, since an interval is a union of few blocks
and an instant lies in one block per size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from berthline.functions.numeric import coalesce_zero, ratio, rounded
from berthline.operators.skew import integer_bucket, running_totals, salted_join
from berthline.schemas import REQUESTS, RESOURCES, TOTALS, USED
from berthline.session import never_broadcast, store

# Width of the time buckets in which running totals are formed: wide enough that a machine's
# buckets stay far fewer than its changes, narrow enough that the busiest machine's bucket
# fits one task. Dense ledgers want it narrower, sparse ones wider.
BUCKET_MS = 86_400_000
# Every clock spans at least this long from time 0 (about 136 years), whatever its grid.
CLOCK_SPAN_MS = 1000 << 32
LARGE_BLOCK_BITS = 10
BLOCK_SALTS = 16
#: Cells of the clock, in bits, by which blocks without an instant are told.
CELL_BITS = 18
BEGINNING_MS = -(1 << 60)
#: Machines that busy_counts tries first, how they multiply, and from where on all others are tried at once.
FIRST_TRIED, WIDEN, LAST_TRIED = 64, 32, 1 << 20


def clock_bits(quantum_ms: int, bits: int | None = None) -> int:
    """Length of a clock in bits of ticks: as given, or enough for CLOCK_SPAN_MS."""
    return max(1, (-(-CLOCK_SPAN_MS // quantum_ms) - 1).bit_length()) if bits is None else bits


def time_bucket(name: str, width_ms: int = BUCKET_MS) -> Column:
    return integer_bucket(F.col(name), width_ms)


def allocation_events(
    allocations: DataFrame, machines: DataFrame | None = None, points: DataFrame | None = None,
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """One row per (machine, instant): tasks and resources taken at, and given back at, that instant.

    The rows lie together by machine and time bucket (column ``bucket``) before they are grouped, so neither the grouping
    nor running totals over these buckets send them again. With ``machines``, each of them also gets an empty row at the beginning of time. With
    ``points`` (machine_id, time_ms), their instants get a row too, marked ``asked``.
    """
    held = allocations.filter(F.col("finish_ms") > F.col("start_ms")).select(
        "machine_id", "start_ms", "finish_ms", *[coalesce_zero(REQUESTS[r]).alias(r) for r in RESOURCES]
    )
    edge = "explode(array(struct(start_ms AS time_ms, 1L AS sign), struct(finish_ms AS time_ms, -1L AS sign))) AS edge"
    edges = held.select("machine_id", F.expr(edge), *RESOURCES).select(
        "machine_id", "edge.time_ms", "edge.sign", *RESOURCES, F.lit(0).alias("asked")
    )
    nothing = [F.lit(0).cast("bigint").alias("sign"), *[F.lit(0.0).alias(r) for r in RESOURCES]]
    if machines is not None:
        first = F.lit(BEGINNING_MS).alias("time_ms")
        edges = edges.unionByName(machines.select("machine_id", first, *nothing, F.lit(0).alias("asked")))
    if points is not None:
        edges = edges.unionByName(points.select("machine_id", "time_ms", *nothing, F.lit(1).alias("asked")))
    taken = {r: f"sum(CASE WHEN sign > 0 THEN {r} ELSE 0.0D END)" for r in RESOURCES}
    dealt = edges.withColumn("bucket", time_bucket("time_ms", bucket_ms)).repartition("machine_id", "bucket")
    return dealt.groupBy("machine_id", "bucket", "time_ms").agg(
        F.max("asked").alias("asked"),
        F.sum("sign").alias("d_active"),
        F.expr("sum(CASE WHEN sign > 0 THEN 1L ELSE 0L END)").alias("s_active"),
        *[F.expr(f"sum(sign * {r})").alias(f"d_{r}") for r in RESOURCES],
        *[F.expr(taken[r]).alias(f"s_{r}") for r in RESOURCES],
    )


_TOTALS = {"active_tasks": "d_active", **{USED[r]: f"d_{r}" for r in RESOURCES}}


def usage_steps(
    allocations: DataFrame, bucket_ms: int = BUCKET_MS, machines: DataFrame | None = None
) -> DataFrame:
    """Usage of each machine from every instant at which it changes until the next one."""
    steps = running_totals(
        allocation_events(allocations, machines, bucket_ms=bucket_ms), ["machine_id"], "time_ms", _TOTALS,
        F.col("bucket"), following="until_ms",
    )
    return steps.select(
        "machine_id", "time_ms", "until_ms", "active_tasks", *[rounded(USED[r]).alias(USED[r]) for r in RESOURCES]
    )


def usage_at(
    points: DataFrame, allocations: DataFrame, strict_start: bool = False, bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """Usage at given (machine_id, time_ms) points.

    Points join the stream of starts and finishes as rows without effect, so the running
    totals answer them directly. ``strict_start`` leaves out tasks that start at the very
    instant (a sample taken before the instant's own allocations).
    """
    # counting the questions as well keeps their flag in both uses of the events inside the
    # running totals, which can then share one exchange
    totals = running_totals(
        allocation_events(allocations, points=points, bucket_ms=bucket_ms), ["machine_id"], "time_ms",
        {**_TOTALS, "asked_so_far": "asked"}, F.col("bucket"),
    ).filter("asked = 1 AND asked_so_far > 0")

    def before_starts(total: str, started: str):
        return F.col(total) - F.col(started) if strict_start else F.col(total)

    return totals.select(
        "machine_id", "time_ms", before_starts("active_tasks", "s_active").alias("active_tasks"),
        *[rounded(before_starts(USED[r], f"s_{r}")).alias(USED[r]) for r in RESOURCES],
    )


def usage_spans(allocations: DataFrame, machines: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Stretches [from_ms, to_ms) of unchanged usage for every machine, from the beginning of time.

    The last stretch of a machine has no end (null).
    """
    steps = usage_steps(allocations, bucket_ms, machines)
    return steps.withColumnsRenamed({"time_ms": "from_ms", "until_ms": "to_ms"})


def idle_spans(allocations: DataFrame, machines: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Stretches [from_ms, to_ms) in which a machine of the fleet has no active task, the last one without an end.

    Along the starts of a machine, it is idle from the latest finish so far to the next start. The latest
    finish is taken bucket by bucket, like a running total, so a busy machine is not one task's.
    """
    held = allocations.filter(F.col("finish_ms") > F.col("start_ms")).select(
        "machine_id", "start_ms", "finish_ms", time_bucket("start_ms", bucket_ms).alias("_bucket")
    )
    fleet = machines.select("machine_id").distinct()
    latest = held.groupBy("machine_id", "_bucket").agg(F.max("finish_ms").alias("_latest")).join(fleet, "machine_id")
    buckets = W.partitionBy("machine_id").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = latest.select("machine_id", "_bucket", F.max("_latest").over(buckets).alias("_before"))
    inside = W.partitionBy("machine_id", "_bucket").orderBy("start_ms").rowsBetween(W.unboundedPreceding, -1)
    along = held.withColumn("_inside", F.max("finish_ms").over(inside)).join(before, ["machine_id", "_bucket"])
    beginning = F.lit(BEGINNING_MS)
    gaps = along.select(
        "machine_id", F.coalesce(F.greatest("_before", "_inside"), beginning).alias("from_ms"), F.col("start_ms").alias("to_ms")
    ).filter("from_ms < to_ms")
    last = fleet.join(latest.groupBy("machine_id").agg(F.max("_latest").alias("_end")), "machine_id", "left").select(
        "machine_id", F.coalesce("_end", beginning).alias("from_ms"), F.lit(None).cast("bigint").alias("to_ms")
    )
    return gaps.unionByName(last)


def instant_tick(time_ms: str, quantum_ms: int, bits: int | None = None) -> Column:
    """Index of an instant on the clock grid; an instant off the grid or beyond the clock is an error."""
    t = F.col(time_ms)
    end = quantum_ms << clock_bits(quantum_ms, bits)
    inside = (F.pmod(t, F.lit(quantum_ms)) == 0) & (t >= 0) & (t < F.lit(end))
    wrong = F.raise_error(F.lit(f"{time_ms} is not a multiple of {quantum_ms} ms from 0 up to {end}")).cast("bigint")
    return F.when(t.isNull(), F.lit(None).cast("bigint")).when(
        inside, F.floor(t / F.lit(quantum_ms)).cast("bigint")
    ).otherwise(wrong)


def cover_blocks(spans: DataFrame, quantum_ms: int = 1000, bits: int | None = None) -> DataFrame:
    """Replace [from_ms, to_ms) by the power-of-two blocks of grid ticks that tile it.

    A tick k lies in the span iff ceil(from) <= k < ceil(to), so spans need not start on
    the grid. A span yields at most two blocks per block size. What lies beyond the clock
    needs no blocks, as no instant can be there.
    """
    bits = clock_bits(quantum_ms, bits)
    grid = float(quantum_ms)
    low = F.greatest(F.ceil(F.col("from_ms") / grid).cast("bigint"), F.lit(0))
    high = F.coalesce(
        F.greatest(F.lit(0), F.least(F.ceil(F.col("to_ms") / grid).cast("bigint"), F.lit(1 << bits))),
        F.lit(1 << bits),
    )
    sized = (
        spans.withColumns({"_lo": low.cast("bigint"), "_hi": high.cast("bigint")})
        .filter(F.col("_hi") > F.col("_lo"))
        .withColumn("block_size", F.explode(F.expr("sequence(0, cast(floor(log2(_hi - _lo)) as int) + 1)")))
        .withColumns(
            {
                "_l": F.expr("shiftright(_lo + shiftleft(1L, block_size) - 1L, block_size)"),
                "_h": F.expr("shiftright(_hi, block_size)"),
            }
        )
        .filter(F.col("_l") < F.col("_h"))
    )
    ends = F.array(
        F.when(F.col("_l") % 2 == 1, F.col("_l")),
        F.when(F.col("_h") % 2 == 1, F.col("_h") - 1),
    )
    return sized.withColumn("block", F.explode(ends)).filter(F.col("block").isNotNull()).drop(
        "_lo", "_hi", "_l", "_h"
    )


def enclosing_blocks(instants: DataFrame, tick: str, bits: int) -> DataFrame:
    """Every block, of each size, that contains the instant's tick."""
    return instants.withColumn("block_size", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn(
        "block", F.expr(f"shiftright({tick}, block_size)")
    )


def asked_only(blocks: DataFrame, ticks: DataFrame, bits: int) -> DataFrame:
    """The blocks around which an instant's tick may lie; no others can answer one.

    The clock is divided into at most 2^CELL_BITS cells, whatever the number of instants, so the blocks
    around the cells in use are few enough to broadcast. A block smaller than a cell goes by its cell.
    """
    fine = max(0, bits - CELL_BITS)
    cells = ticks.select(F.shiftright("tick", fine).alias("_cell")).distinct()
    used = cells.select(F.explode(F.sequence(F.lit(0), F.lit(bits - fine))).alias("_size"), "_cell").select(
        "_size", F.expr("shiftright(_cell, _size)").alias("_around")
    ).distinct()
    size, above = F.greatest(F.col("block_size") - fine, F.lit(0)), F.expr(f"shiftright(block, greatest({fine} - block_size, 0))")
    return blocks.join(F.broadcast(used), (size == F.col("_size")) & (above == F.col("_around")), "left_semi")


def _join_blocks(ticks: DataFrame, blocks: DataFrame, bits: int, also: list[str] = ()) -> DataFrame:
    """Match ticks with the blocks around them.

    Every tick lies in the few largest blocks, so those sizes are salted; small blocks hold
    a bounded number of ticks and need no copies.
    """
    large = F.col("block_size") >= F.lit(bits - LARGE_BLOCK_BITS)
    asked = enclosing_blocks(ticks, "tick", bits).withColumn(
        "_salt", F.when(large, F.pmod(F.xxhash64("tick"), F.lit(BLOCK_SALTS)).cast("int")).otherwise(0)
    )
    copies = F.when(large, F.sequence(F.lit(0), F.lit(BLOCK_SALTS - 1))).otherwise(F.array(F.lit(0)))
    # an instant has a row for every size, so a few instants are many rows
    return never_broadcast(asked).join(blocks.withColumn("_salt", F.explode(copies)), ["block_size", "block", "_salt", *also])


def free_by_class(
    instants: DataFrame, spans: DataFrame, classes: list[str], quantum_ms: int = 1000, bits: int | None = None
) -> DataFrame:
    """Per instant and machine class: how many members are in a span, and the smallest id.

    ``spans`` carries machine_id, from_ms, to_ms and the class columns; ``instants`` the
    column time_ms. Counts and minima are added up over cover blocks, so neither machines
    nor tasks are listed per instant.
    """
    ticks = instants.select("time_ms").distinct().withColumn("tick", instant_tick("time_ms", quantum_ms, bits))
    bits = clock_bits(quantum_ms, bits)
    blocks = asked_only(cover_blocks(spans, quantum_ms, bits), ticks, bits).groupBy(*classes, "block_size", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("machine_id").alias("first_id")
    )
    return (
        _join_blocks(ticks, blocks, bits)
        .groupBy("time_ms", *classes)
        .agg(F.sum("n").alias("n_free"), F.min("first_id").alias("first_free_id"))
    )


def free_members(
    instants: DataFrame, spans: DataFrame, classes: list[str], quantum_ms: int = 1000, bits: int | None = None
) -> DataFrame:
    """The machines in a span at each instant, one row per (instant, machine).

    Instants that carry the class columns list the machines of their own class only.
    """
    asked = [c for c in classes if c in instants.columns]
    ticks = instants.select("time_ms", *asked).distinct().withColumn("tick", instant_tick("time_ms", quantum_ms, bits))
    bits = clock_bits(quantum_ms, bits)
    blocks = asked_only(cover_blocks(spans, quantum_ms, bits), ticks, bits).select(*classes, "machine_id", "block_size", "block")
    return _join_blocks(ticks, blocks, bits, asked).select("time_ms", *classes, "machine_id")


def first_members(
    asked: DataFrame, spans: DataFrame, quantum_ms: int = 1000, bits: int | None = None, digit: int = 8
) -> DataFrame:
    """The ``n`` smallest ids among the machines in a span at an instant, over the classes of a unit.

    ``asked`` has a row (time_ms, unit, class_id, n) for each class of a unit. The cover blocks
    count their members by leading digits of the id, so the ids are found like the n-th key of a search
    tree: digit by digit, only where one of the n smallest can lie. Returns (time_ms, unit, slot, machine_id).
    """
    width = clock_bits(quantum_ms, bits)
    near = asked.withColumn("tick", instant_tick("time_ms", quantum_ms, bits)).withColumn(
        "_up", F.lit(0).cast("bigint")  # digits of the id that are known
    )
    members = store(
        asked_only(cover_blocks(spans, quantum_ms, bits), near, width).select("class_id", "block_size", "block", "machine_id"),
        "block-members",
    )
    ends = members.agg(F.min("machine_id").alias("lo"), F.max("machine_id").alias("hi")).first()
    empty = asked.select("time_ms", "unit", F.lit(0).cast("bigint").alias("slot"), F.lit(0).cast("bigint").alias("machine_id"))
    if ends.lo is None:
        return empty.limit(0)
    levels = max(1, -(-(int(ends.hi) - int(ends.lo)).bit_length() // digit))
    offset = F.col("machine_id") - F.lit(int(ends.lo))
    for level in range(levels - 1, -1, -1):
        counts = members.groupBy(
            "class_id", "block_size", "block", F.shiftright(offset, digit * level).alias("_at")
        ).agg(F.count(F.lit(1)).alias("_n")).withColumn("_up", F.shiftright("_at", digit))
        met = _join_blocks(near, counts, width, ["class_id", "_up"])
        found = store(met.groupBy("time_ms", "unit", "class_id", "n", "_at").agg(F.sum("_n").alias("_n")), "tree-level")
        nodes = never_broadcast(found.groupBy("time_ms", "unit", "n", "_at").agg(F.sum("_n").alias("_n")))
        totals = running_totals(nodes, ["time_ms", "unit"], "_at", {"_upto": "_n"}, integer_bucket(F.col("_at"), 4096))
        needed = totals.filter(F.col("_upto") - F.col("_n") < F.col("n"))
        if not level:
            return needed.select(
                "time_ms", "unit", F.col("_upto").alias("slot"), (F.col("_at") + F.lit(int(ends.lo))).alias("machine_id")
            )
        kept = never_broadcast(found.drop("_n")).join(needed.select("time_ms", "unit", "_at"), ["time_ms", "unit", "_at"])
        near = store(kept.withColumn("tick", instant_tick("time_ms", quantum_ms, bits)).withColumnRenamed("_at", "_up"), "tree-nodes")
    return empty


def free_counts(instants: DataFrame, spans: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Per instant (time_ms): how many machines are in a span.

    Instants join the stream of spans that begin and end as rows without effect, and one running
    total answers all of them.
    """
    edges = "explode(array(struct(from_ms AS time_ms, 1L AS step), struct(to_ms AS time_ms, -1L AS step))) AS edge"
    steps = spans.select(F.expr(edges)).select("edge.time_ms", "edge.step", F.lit(0).alias("asked")).filter("time_ms IS NOT NULL")
    asked = instants.filter("time_ms IS NOT NULL").select("time_ms", F.lit(0).cast("bigint").alias("step"), F.lit(1).alias("asked"))
    events = steps.unionByName(asked).groupBy("time_ms").agg(F.sum("step").alias("step"), F.max("asked").alias("asked"))
    totals = running_totals(
        events, [], "time_ms", {"n_free": "step", "asked_so_far": "asked"}, time_bucket("time_ms", bucket_ms)
    )
    return totals.filter("asked = 1 AND asked_so_far > 0").select("time_ms", "n_free")


def busy_counts(
    instants: DataFrame, allocations: DataFrame, machines: DataFrame, quantum_ms: int = 1000, bits: int | None = None,
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Per instant: machines busy, machines free, and the smallest free id.

    The counts need no cover blocks; those only find the smallest id. Machines are tried in the order of
    their ids, FIRST_TRIED at first and then WIDEN times as many each time, for the instants
    that have a free machine and have not found one yet.
    """
    spans = store(idle_spans(allocations, machines, bucket_ms), "idle-spans")
    times = instants.select("time_ms").distinct()
    answers = times.join(free_counts(times, spans, bucket_ms), "time_ms", "left").withColumn(
        "n_free", F.coalesce("n_free", F.lit(0)).cast("bigint")
    )
    size = machines.agg(F.count(F.lit(1))).scalar()
    found, tried, above, ids = [], FIRST_TRIED, None, machines.select("machine_id").filter("machine_id IS NOT NULL")
    while True:
        later, within = (df if above is None else df.filter(F.col("machine_id") > above) for df in (ids, spans))
        last = later.orderBy("machine_id").offset(tried - 1).limit(1).first() if tried < LAST_TRIED else None
        within = within if last is None else within.filter(F.col("machine_id") <= last[0])
        first = free_by_class(answers.select("time_ms"), within.withColumn("_any", F.lit(0)), ["_any"], quantum_ms, bits)
        answers = answers.join(first.select("time_ms", "first_free_id"), "time_ms", "left")
        if last is not None:
            answers = store(answers, "first-free")
        open_instants = F.col("first_free_id").isNull() & (F.col("n_free") > 0)
        left = answers.filter(open_instants).drop("first_free_id")
        if last is None or left.isEmpty():
            found.append(answers)
            break
        found.append(answers.filter(~open_instants))
        answers, tried, above = left, tried * WIDEN, last[0]
    return reduce(DataFrame.unionByName, found).select("time_ms", (size - F.col("n_free")).alias("n_busy"), "n_free", "first_free_id")


def free_pairs(pairs: DataFrame, allocations: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Keep the (machine_id, time_ms) rows whose machine has no active task then."""
    busy = usage_at(pairs, allocations, bucket_ms=bucket_ms)
    return pairs.join(busy.filter("active_tasks > 0"), ["machine_id", "time_ms"], "left_anti")


def busy_pairs(pairs: DataFrame, allocations: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Keep the (machine_id, time_ms) rows whose machine is at work then."""
    busy = usage_at(pairs, allocations, bucket_ms=bucket_ms)
    return pairs.join(busy.filter("active_tasks > 0"), ["machine_id", "time_ms"], "left_semi")


def with_utilization(usage: DataFrame, machines: DataFrame) -> DataFrame:
    """Used over total per resource; a machine without GPU counts as total 1."""
    totals = machines.select("machine_id", *[F.col(TOTALS[r]).alias(f"_{r}") for r in RESOURCES])
    return (
        salted_join(usage, totals, ["machine_id"], ["time_ms"])
        .withColumns(
            {
                "cpu_util": ratio(F.col(USED["cpu"]), F.col("_cpu")),
                "gpu_util": F.col(USED["gpu"]) / F.greatest(F.lit(1.0), F.col("_gpu")),
                "ram_util": ratio(F.col(USED["ram"]), F.col("_ram")),
            }
        )
        .drop(*[f"_{r}" for r in RESOURCES])
    )


def utilization_timeline(allocations: DataFrame, machines: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Utilisation and active tasks of each machine at every change."""
    return with_utilization(usage_steps(allocations, bucket_ms), machines)
