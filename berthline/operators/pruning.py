"""Which machine classes can matter to a request, decided for whole boxes of requests at once.

Both raw scores are linear in the request: the fit of a class falls and its watts rise by a fixed
amount for each unit asked for. Over a box of requests the difference of two classes therefore has
its extremes at corners of the box, one resource at a time. A class matters to no request of a box if
it can hold none, or if for every request other classes that surely fit take all of its roles:

- one of the four extremes (least and most fit, least and most watts) always lies with another class;
- at least ``k`` other classes always score better.

Boxes are cells of a grid over the requests, shrunk to the requests inside. Coarse cells come
first; finer ones only meet the classes that mattered to the cell around them. Pairs of requests
and classes are formed at the end, inside the finest cells, and are scored exactly, so results do not
depend on the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from berthline.functions import scoring
from berthline.functions.scoring import number
from berthline.operators.candidates import capable_pairs
from berthline.operators.skew import spread
from berthline.schemas import REMAINING, REQUEST_COLUMNS, REQUESTS, RESOURCES, TOTALS
from berthline.session import store

#: Grid steps for each doubling of a request, from coarse to fine.
LEVELS = (0.5, 2.0, 8.0, 32.0)
#: Requests that the cells of a level must hold on average to be worth it: bounds cost more than pairs.
CROWDED = 16
#: Requests of a cell that share one copy of its classes.
SHARE = 4096
#: Least difference that rounding cannot turn around, of raw scores and of final scores.
RAW_SLACK, SCORE_SLACK = 1e-11, 3e-9

_MOST = number(1.7e308)


def _cell(steps: float) -> str:
    """Grid cell of a request; other cells may share the number, which only makes a box wider."""
    parts = [
        f"CASE WHEN {REQUESTS[r]} <= 0 THEN 0 ELSE 100000 + CAST(floor(log(2.0D, {REQUESTS[r]}) * {number(steps)}) AS INT) END"
        for r in RESOURCES
    ]
    return f"xxhash64({', '.join(parts)})"


def _lines(profile: str, overrides: scoring.PowerOverrides) -> str:
    """A class's fit and watts as lines: values without a request, and change for each unit asked for."""
    most = {r: f"greatest({TOTALS[r]}, {number(scoring.EPS)})" for r in RESOURCES}
    fit = " + ".join(f"{REMAINING[r]} / {most[r]} / 4.0D" for r in RESOURCES)
    unit = scoring.unit_watts(profile, overrides)
    return (
        f"named_struct('id', class_id, 'fit', {fit}, "
        + ", ".join(f"'f_{r}', -0.25D / {most[r]}, 'w_{r}', CAST({unit[r]} AS DOUBLE)" for r in RESOURCES) + ")"
    )


def _line(of: str, kind: str, at: str) -> str:
    """Value of one line at a place, ``{r}`` in ``at`` standing for the resource."""
    first = f"{of}.fit + " if kind == "f" else ""
    return first + " + ".join(f"{of}.{kind}_{r} * {at.format(r=r)}" for r in RESOURCES)


def _corner(kind: str, a: str, b: str | None = None, pick: str = "least") -> str:
    """Least (or greatest) value over the box of line ``a``, or of its difference to line ``b``."""
    minus = (lambda x: f"({a}.{x} - {b}.{x})") if b else (lambda x: f"{a}.{x}")
    first = f"{minus('fit')} + " if kind == "f" else ""
    return "(" + first + " + ".join(
        f"{pick}({minus(f'{kind}_{r}')} * _lo_{r}, {minus(f'{kind}_{r}')} * _hi_{r})" for r in RESOURCES
    ) + ")"


def _same(kind: str, a: str, b: str) -> str:
    """Whether two lines are equal number by number."""
    names = [f"{kind}_{r}" for r in RESOURCES] + (["fit"] if kind == "f" else [])
    return " AND ".join(f"{a}.{x} = {b}.{x}" for x in names)


def _floored(watts: str, profile: str) -> str:
    return f"greatest({number(scoring.TOTAL_FLOOR_W)}, {watts})" if profile == "floored" else f"({watts})"


def _least_gap(kind: str, a: str, b: str, profile: str) -> str:
    """Least difference over the box of the raw scores of ``a`` and ``b``."""
    plain = _corner(kind, a, b)
    if kind == "f" or profile != "floored":
        return plain
    return f"least({plain}, greatest({_corner('w', a)} - {number(scoring.TOTAL_FLOOR_W)}, 0.0D))"


def _boxes(shapes: DataFrame, cell: str, *more: Column) -> DataFrame:
    """Cells with their box and the number of requests inside."""
    return shapes.groupBy(F.col(cell).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_n"), *more,
        *[F.min(REQUESTS[r]).alias(f"_lo_{r}") for r in RESOURCES],
        *[F.max(REQUESTS[r]).alias(f"_hi_{r}") for r in RESOURCES],
    )


def _pivots(live: DataFrame, alpha: float, profile: str) -> DataFrame:
    """Per cell the classes that surely fit with the four extremes at its middle, and weights of raw differences.

    A difference of fits (watts) enters the final score divided by the span of fits (watts) among
    the candidates of a request; over the box that factor lies between _b_lo and _b_hi (_a_lo
    and _a_hi). A span that counts as flat has a factor of its own.
    """
    f_low, f_high = _corner("f", "_line"), f"{_corner('f', '_line', pick='greatest')} + _bend"
    w_low, w_high = (_floored(_corner("w", "_line", pick=p), profile) for p in ("least", "greatest"))
    box = [f"_{end}_{r}" for end in ("lo", "hi") for r in RESOURCES]
    found = live.groupBy("_cell").agg(
        *[F.expr(f"{how}_by(_line, _{kind}_mid) FILTER (WHERE _sure)").alias(f"_{kind}_{how}")
          for kind in "fw" for how in ("min", "max")],
        F.expr(f"max({f_high}) - min({f_low})").alias("_f_most"), F.expr(f"max({w_high}) - min({w_low})").alias("_w_most"),
        F.expr(f"max({w_high})").alias("_w_top"), *[F.first(c).alias(c) for c in box],
    )
    spans = found.withColumns({
        "_f_least": F.expr(f"greatest(coalesce({_corner('f', '_f_max', '_f_min')}, 0.0D), 0.0D)"),
        "_w_least": F.expr(f"greatest(coalesce({_least_gap('w', '_w_max', '_w_min', profile)}, 0.0D), 0.0D)"),
    })
    flat_f, flat_w = number(scoring.FLAT_FIT), number(scoring.FLAT_WATTS[profile])
    if profile == "floored":
        low_f, low_w = "least(try_divide(1.0D, _f_most), 1.0D)", "try_divide(1.0D, greatest(_w_top, _w_most))"
    else:
        low_f = low_w = "0.0D"
    a, b = number(alpha), number(1.0 - alpha)
    return spans.withColumns({
        "_a_lo": F.expr(f"{a} * CASE WHEN _w_least >= {flat_w} THEN try_divide(1.0D, _w_most) ELSE {low_w} END"),
        "_a_hi": F.expr(f"{a} / greatest(_w_least, {flat_w})"),
        "_b_lo": F.expr(f"{b} * CASE WHEN _f_least >= {flat_f} THEN try_divide(1.0D, _f_most) ELSE {low_f} END"),
        "_b_hi": F.expr(f"{b} * greatest(1.0D, 1.0D / greatest(_f_least, {flat_f}))"),
    }).drop("_f_most", "_w_most", "_w_top", "_f_least", "_w_least", *box)


def _prune(live: DataFrame, alpha: float, profile: str, k: int) -> DataFrame:
    """The rows of ``live`` (_cell, box, _line, remaining capacity) whose class can matter to its cell."""
    middle = "((_lo_{r} + _hi_{r}) / 2.0D)"
    live = store(live.withColumns({
        "_sure": F.expr(" AND ".join(f"{REMAINING[r]} >= _hi_{r}" for r in RESOURCES)),
        # beyond the capacity, by at most EPS, a leftover counts as positive: the line is too low there by this much
        "_bend": F.expr(" + ".join(
            f"CASE WHEN {REMAINING[r]} >= _hi_{r} THEN 0.0D ELSE -2.0D * _line.f_{r} * {number(scoring.EPS)} END" for r in RESOURCES
        )),
        "_f_mid": F.expr(_line("_line", "f", middle)),
        "_w_mid": F.expr(_floored(_line("_line", "w", middle), profile)),
    }), "live-classes")
    pivots = store(_pivots(live, alpha, profile), "pivots")
    pivot = "_f_min" if alpha < 0.5 else "_w_min"
    roles = {  # who is never above whom, if the class need not be looked at for an extreme
        "_f_min": ("f", "_f_min", "_line"), "_f_max": ("f", "_line", "_f_max"),
        "_w_min": ("w", "_w_min", "_line"), "_w_max": ("w", "_line", "_w_max"),
    }
    gaps = spread(live, ["_cell", "class_id"]).join(pivots, "_cell").withColumns({
        **{f"_gap{p}": F.expr(_least_gap(kind, high, low, profile)) for p, (kind, low, high) in roles.items()},
        **{f"_same{p}": F.expr(_same(kind, low, high)) for p, (kind, low, high) in roles.items()},
        **{f"_over_{kind}": F.expr(_least_gap(kind, "_line", pivot, profile)) for kind in "fw"},
        **{f"_under_{kind}": F.expr(f"-({_least_gap(kind, pivot, '_line', profile)})") for kind in "fw"},
    })
    open_roles = []
    for p in roles:
        margin = "_bend" if p == "_f_max" else "0.0D"
        wide = f"_gap{p} - {margin} > {number(RAW_SLACK)} AND _gap{p} < {_MOST}"
        open_roles.append(f"{p}.id IS NULL OR {p}.id = _line.id OR NOT ((_same{p} AND {margin} = 0.0D) OR ({wide}))")

    def weighed(kind: str, side: str) -> str:
        gap, name = f"_{side}_{kind}", {"w": "a", "f": "b"}[kind]
        gains, loses = ("lo", "hi") if side == "over" else ("hi", "lo")
        return f"{gap} * CASE WHEN {gap} >= 0 THEN _{name}_{gains} ELSE _{name}_{loses} END"

    scored = store(gaps.select(
        *live.columns, F.expr(" OR ".join(open_roles)).alias("_extreme"),
        F.expr(f"{weighed('w', 'over')} + {weighed('f', 'over')}").alias("_best"),
        F.expr(f"{weighed('w', 'under')} + {weighed('f', 'under')}").alias("_worst"),
    ), "bounded-classes")
    # a class beyond the worst case of k others is never among the k best
    first = W.partitionBy("_cell").orderBy("_worst")
    limit = (
        scored.filter("_sure AND _worst IS NOT NULL AND NOT isnan(_worst)").select("_cell", "_worst")
        .withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= k)
        .groupBy("_cell").agg(F.max("_worst").alias("_limit"), F.count(F.lit(1)).alias("_of"))
        .filter(F.col("_of") == k).drop("_of")
    )
    kept = scored.join(limit, "_cell", "left").filter(
        F.expr(f"_extreme OR _limit IS NULL OR _best IS NULL OR NOT (_best > _limit + {number(SCORE_SLACK)} AND _best < {_MOST})")
    )
    return kept.drop("_sure", "_bend", "_f_mid", "_w_mid", "_extreme", "_best", "_worst", "_limit")


def surviving_classes(
    shapes: DataFrame, classes: DataFrame, alpha: float, profile: str = "floored",
    overrides: scoring.PowerOverrides = scoring.PowerOverrides(), k: int = 1, levels: tuple[float, ...] = LEVELS,
) -> tuple[DataFrame, DataFrame]:
    """(shapes with their _cell, classes that can matter to each _cell); both are stored tables.

    Requests that are not finite numbers can be met by no machine and are left out.
    """
    names = [f"_cell{i}" for i in range(len(levels))]
    finite = " AND ".join(f"abs({c}) < CAST('Infinity' AS DOUBLE)" for c in REQUEST_COLUMNS)
    placed = store(
        shapes.select(*REQUEST_COLUMNS).filter(finite).withColumns({n: F.expr(_cell(s)) for n, s in zip(names, levels)}),
        "request-cells",
    )
    total = placed.count()
    lines = classes.withColumn("_line", F.expr(_lines(profile, overrides)))
    boxes = store(_boxes(placed, names[0]), "cells")
    corner = boxes.withColumns({REQUESTS[r]: F.col(f"_lo_{r}") for r in RESOURCES})
    live = _prune(capable_pairs(corner, lines).drop(*REQUEST_COLUMNS), alpha, profile, k)
    last = names[0]
    for name in names[1:]:
        # a finer cell inside a coarser one; cells of one number but of several coarse ones stay apart
        finer = placed.withColumn("_inner", F.xxhash64(last, name)).drop(name).withColumnRenamed("_inner", name)
        boxes = store(_boxes(finer, name, F.first(last).alias("_outer")), "cells")
        if total < CROWDED * boxes.count():
            break
        placed = finer
        old = live.drop("_n", *[f"_{end}_{r}" for end in ("lo", "hi") for r in RESOURCES]).withColumnRenamed("_cell", "_outer")
        inside = spread(boxes, ["_cell"]).join(old, "_outer").drop("_outer").filter(
            " AND ".join(f"{REMAINING[r]} + {number(scoring.EPS)} >= _lo_{r}" for r in RESOURCES)
        )
        live, last = _prune(inside, alpha, profile, k), name
    return store(placed.select(*REQUEST_COLUMNS, F.col(last).alias("_cell")), "request-cells"), store(
        live.drop("_line", *[f"_{end}_{r}" for end in ("lo", "hi") for r in RESOURCES]), "surviving-classes"
    )


def pruned_pairs(placed: DataFrame, survivors: DataFrame, eps: float = scoring.EPS) -> DataFrame:
    """Every request with the classes that matter to its _cell and fit it.

    The classes of a cell are copied once for every SHARE of its requests, which are dealt out
    by a hash, so a crowded cell does not end up in one task.
    """
    shares = survivors.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"_n div {SHARE}"))))
    sizes = survivors.select("_cell", "_n").distinct()
    dealt = placed.join(sizes, "_cell").withColumn(
        "_salt", F.expr(f"pmod(xxhash64({', '.join(REQUEST_COLUMNS)}), _n div {SHARE} + 1)")
    )
    asked, offered = (spread(side.drop("_n"), ["_cell", "_salt"], hashed=False) for side in (dealt, shares))
    return asked.join(offered, ["_cell", "_salt"]).filter(scoring.fits(eps)).drop("_salt")
