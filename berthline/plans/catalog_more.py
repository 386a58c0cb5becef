"""Named queries over incomplete inputs, and round trips through the file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from berthline.functions.numeric import lehmer_sql
from berthline.ml.learners import search_forest, train, train_patiently
from berthline.ml.serving import external_scorer, load_model, model_status, save_model, saved_metrics, score
from berthline.ml.stumps import search_stumps
from berthline.operators import intake, ledger as ld, metrics as mt, occupancy as oc, reports as rp, splits
from berthline.plans import catalog as ct
from berthline.plans import fixtures as fx
from berthline.plans import oracle_parts as op
from berthline.plans import reporting
from berthline.plans.catalog import ORACLES, query, r6, with_ctes
from berthline.plans.training import train_evaluate
from berthline.schemas import FEATURE_COLUMNS, MODEL_META_SCHEMA, TOTALS, USED
from berthline.session import scratch_path
from berthline.sources import files
from berthline.streaming import jobs as st

# ---- incomplete inputs ---------------------------------------------------------------------

# Every 13th row has no probability, every 4th no model. For SQL the missing model is '~', as
# its joins would drop nulls.
_GAPS = with_ctes(op.SCORED_CTE.replace("scored AS (", "scored1 AS (")) + """, scored AS (
  SELECT row_id, y, p, CASE WHEN row_id % 4 = 0 THEN '~' ELSE model_used END AS model_used
  FROM scored1 WHERE row_id % 13 <> 0)"""


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("row_id")
    return fx.scored(spark, sf).withColumns(
        {"p": F.when(k % 13 != 0, F.col("p")), "model_used": F.when(k % 4 != 0, F.col("model_used"))}
    )


def _over_gaps(name: str) -> str:
    """The SQL of a query over scored rows, over those with gaps."""
    return ORACLES[name].replace(ct._SC, _GAPS)


@query(
    f"""SELECT r.* REPLACE (nullif(r.model_used, '~') AS model_used), n_unscored, n_scored FROM ({_over_gaps('evaluate_report')}) r
    JOIN (SELECT CASE WHEN o_orderkey % 4 = 0 THEN '~' ELSE 'm' || CAST(o_orderkey % 3 AS VARCHAR) END AS model_used,
      count(*) FILTER (WHERE o_orderkey % 13 = 0) AS n_unscored, count(*) FILTER (WHERE o_orderkey % 13 <> 0) AS n_scored
      FROM orders GROUP BY 1) u USING (model_used)"""
)
def evaluate_report_unscored(spark, sf):
    rows = _gaps(spark, sf)
    report = mt.evaluate_report(rows, 0.59, ["model_used"])
    left = mt.unscored_counts(rows, ["model_used"]).withColumnRenamed("model_used", "_model")
    joined = report.join(left, F.col("model_used").eqNullSafe(F.col("_model"))).drop("_model")
    return joined.withColumns({c: F.round(c, 6) for c in (*ct._QUALITY_NAMES, "roc_auc", "average_precision")})


@query(f"SELECT * REPLACE (nullif(model_used, '~') AS model_used) FROM ({_over_gaps('cumulative_confusion')}) q")
def cumulative_confusion_unscored(spark, sf):
    out = mt.cumulative_confusion(_gaps(spark, sf), ["model_used"])
    return out.select("model_used", *r6("p"), "pos", "neg", "tp", "fp")


@query(f"SELECT * REPLACE (nullif(model_used, '~') AS model_used) FROM ({_over_gaps('log_loss')}) q")
def log_loss_unscored(spark, sf):
    return mt.log_loss(_gaps(spark, sf), ["model_used"]).select("model_used", *r6("log_loss"))


@query(_over_gaps("threshold_sweep"))
def threshold_sweep_unscored(spark, sf):
    out = mt.threshold_sweep(_gaps(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("threshold", *ct._QUALITY_NAMES)})


@query(_over_gaps("pick_threshold"))
def pick_threshold_unscored(spark, sf):
    out = mt.pick_threshold(_gaps(spark, sf), 0.9)
    return out.withColumns({c: F.round(c, 6) for c in ("threshold", *ct._QUALITY_NAMES)})


@query(_over_gaps("fit_temperature"))
def fit_temperature_unscored(spark, sf):
    return mt.fit_temperature(_gaps(spark, sf)).select(*r6("temperature", "log_loss"))


@query(
    "SELECT * REPLACE (nullif(model_used, '~') AS model_used) FROM ("
    + ORACLES["sla_box_stats"].replace(
        "placements0 AS (",
        "placements0 AS (SELECT * REPLACE (CASE WHEN task_id % 4 = 0 THEN '~' ELSE model_used END AS model_used) FROM (", 1
    ).replace("\n), placements AS", "\n)), placements AS", 1) + ") q"
)
def sla_box_stats_unnamed(spark, sf):
    rows = fx.placements(spark, sf).withColumn("model_used", F.when(F.col("task_id") % 4 != 0, F.col("model_used")))
    out = rp.sla_box_stats(rows)
    return out.select("model_used", "n", *r6("q1", "median", "q3", "p_min", "p_max", "fence_low", "fence_high"))


_UNLABELLED = with_ctes(op.SCORED_CTE) + f""", o AS (SELECT row_id, CASE WHEN row_id % 5 = 0 THEN 9 ELSE y END AS k FROM scored),
    n AS (SELECT row_id, k, row_number() OVER (PARTITION BY k ORDER BY {lehmer_sql('row_id', 42)}, row_id) AS rn,
      count(*) OVER (PARTITION BY k) AS n FROM o)
    SELECT row_id, nullif(k, 9) AS y, rn <= floor(n * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS is_val FROM n"""


@query(_UNLABELLED)
def stratified_split_unlabelled(spark, sf):
    rows = fx.scored(spark, sf).select("row_id", F.when(F.col("row_id") % 5 != 0, F.col("y")).alias("y"))
    return splits.stratified_split(rows, "y", "row_id")


@query(ORACLES["busy_asof"])
def busy_asof_ms(spark, sf):
    """The idle machines at each arrival on a millisecond clock."""
    return oc.busy_counts(ct._instants(spark, sf), fx.allocations(spark, sf), fx.machines(spark, sf), quantum_ms=1)


def _predict_partly(model, batch):
    if (batch["req_cpu_cores"].to_numpy() == 3.0).any():
        raise ValueError("no answer for three cores")
    return ct._predict_external(model, batch)


@query(f"SELECT s.row_id, CASE WHEN f.req_cpu_cores <> 3 THEN p END AS p FROM ({ORACLES['score_external']}) s"
       f" JOIN ({ct._FT} SELECT row_id, req_cpu_cores FROM features) f USING (row_id)")
def score_external_partial(spark, sf):
    """A model that fails on some rows leaves the scores of the others."""
    scored = external_scorer(ct._load_external, _predict_partly)(fx.features(spark, sf))
    return scored.select("row_id", F.round("p", 6).alias("p"))


# ---- sources and sinks ---------------------------------------------------------------------


@query(ORACLES["intake_clean"])
def read_tasks(spark, sf):
    path = files.write_csv(fx.raw_tasks(spark, sf), scratch_path(spark, "tasks"))
    return intake.clean_tasks(files.read_tasks(spark, path), ["task_id"]).withColumn("task_id", F.col("task_id").cast("bigint"))


@query(
    ct._FT + "SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURE_COLUMNS) + ", sla_violation FROM features"
)
def read_features_and_labels(spark, sf):
    """Features and labels written as ordered files of their own and joined again by their order."""
    rows = fx.features(spark, sf).orderBy("row_id")
    features = files.write_csv(rows.select(*FEATURE_COLUMNS), scratch_path(spark, "features"))
    labels = files.write_csv(rows.select("sla_violation"), scratch_path(spark, "labels"))
    joined = files.attach_labels(files.read_features(spark, features), files.read_labels(spark, labels))
    return joined.select("row_id", *r6(*FEATURE_COLUMNS), "sla_violation")


@query(with_ctes(op.SCORED_CTE) + """SELECT model_used, round(avg(p), 6) AS threshold, CAST(1 AS DOUBLE) AS temperature,
    CAST(NULL AS DOUBLE) AS recall_target, 0 AS n_features FROM scored GROUP BY model_used""")
def model_meta_files(spark, sf):
    """Metadata written for every model, read back with the defaults for what it lacks."""
    means = fx.scored(spark, sf).groupBy("model_used").agg(F.avg("p").alias("threshold"))
    empty = {f.name: F.lit(None).cast(f.dataType) for f in MODEL_META_SCHEMA.fields if f.name != "threshold"}
    meta = means.withColumns(empty)
    root = scratch_path(spark, "meta")
    read = []
    for name in ("m0", "m1", "m2"):
        path = files.write_model_meta(meta.filter(F.col("model_used") == name), f"{root}/{name}")
        read.append(files.read_model_meta(spark, path).withColumn("model_used", F.lit(name)))
    back = read[0].unionByName(read[1]).unionByName(read[2])
    return back.select("model_used", *r6("threshold"), "temperature", "recall_target", F.size("feature_cols").alias("n_features"))


@query(ORACLES["class_metrics"])
def metrics_files(spark, sf):
    metrics = ct.class_metrics(spark, sf)
    return spark.read.schema(metrics.schema).json(files.write_metrics(metrics, scratch_path(spark, "metrics")))


@query(with_ctes(op.PLACEMENTS_CTE) + """SELECT task_id, status, machine_id, round(sla_probability, 6) AS sla_probability,
    round(energy_score, 6) AS energy_score, round(fit_score, 6) AS fit_score, model_used FROM placements""")
def results_files(spark, sf):
    rows = fx.placements(spark, sf)
    path = files.write_results(rows, scratch_path(spark, "results"))
    back = spark.read.schema(rows.schema).option("header", True).csv(path)
    return back.select("task_id", "status", "machine_id", *r6("sla_probability", "energy_score", "fit_score"), "model_used")


@query(ORACLES["machine_snapshot"])
def machines_files(spark, sf):
    rows = ct.machine_snapshot(spark, sf)
    return spark.read.parquet(files.write_machines(rows, scratch_path(spark, "machines"), "parquet"))


@query(ORACLES["utilization_timeline"])
def utilization_files(spark, sf):
    rows = ct.utilization_timeline(spark, sf)
    path = files.write_utilization(rows, scratch_path(spark, "utilization"))
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query(with_ctes(op.TASKS_CTE) + "SELECT task_id, arrival_ms, req_cpu_cores, req_ram_gb, execution_time FROM tasks")
def stream_task_files(spark, sf):
    """Task files of a folder, read as a stream of several batches."""
    folder = scratch_path(spark, "task-files")
    fx.tasks(spark, sf).repartition(4, "task_id").write.parquet(folder)
    rows = files.stream_tasks(spark, folder, files_per_trigger=1).select(
        "task_id", "arrival_ms", "req_cpu_cores", "req_ram_gb", "execution_time"
    )
    return st.read_appended(spark, ct._run(spark, "stream_task_files", rows), rows.schema)


@query(
    with_ctes(op.MACHINES_CTE) + "SELECT machine_id, cpu_cores_used, gpu_cores_used, gpu_vram_used_gb, ram_used_gb FROM machines"
)
def used_from_free(spark, sf):
    """Usage from the free amounts of a fleet."""
    machines = fx.machines(spark, sf)
    free = machines.select(
        "machine_id", *TOTALS.values(), *[(F.col(TOTALS[r]) - F.col(USED[r])).alias(f"free_{r}") for r in TOTALS]
    )
    return ld.used_from_free(free, {r: f"free_{r}" for r in TOTALS}).select("machine_id", *USED.values())


@query(ct._FT + "SELECT count(*) AS n, count(*) AS n_same, TRUE AS available, CAST(0.7 AS DOUBLE) AS threshold FROM features")
def saved_model(spark, sf):
    """A trained model scores alike after it was saved and loaded."""
    rows = fx.features(spark, sf)
    root = scratch_path(spark, "models")
    model = train("lr", rows)
    save_model(model, root, "first", spark, threshold=0.7)
    loaded, meta = load_model(root, "first", spark)
    both = score(loaded, score(model, rows.select("row_id", *FEATURE_COLUMNS)).withColumnRenamed("p", "p0"))
    status = model_status(spark, root, [meta["name"]]).first()
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("p") - F.col("p0")) < 1e-12).alias("n_same"),
        F.lit(status["available"]).alias("available"), F.lit(status["threshold"]).alias("threshold"),
    )


# ---- searches and training results without SQL ----------------------------------------------


@query()
def train_gb(spark, sf):
    """The preset of 300 rounds, saved with its calibration and metrics, which are read back."""
    trained = train_evaluate("gb", *ct._train_test(spark, sf))
    root = scratch_path(spark, "models")
    trained.save(root, "gb")
    metrics = trained.metrics
    return saved_metrics(spark, root, "gb", metrics.schema).select(*metrics.columns)


@query()
def early_stopping(spark, sf):
    """Loss of every fitted round on held-out rows, and the round at which patience cuts the model; a tenth of the labels is wrong."""
    rows = fx.features(spark, sf).withColumn(
        "sla_violation", F.when(F.crc32(F.col("row_id").cast("string")) % 10 == 0, 1 - F.col("sla_violation")).otherwise(F.col("sla_violation"))
    )
    fitted = train_patiently("xgb", rows, overrides={"maxIter": 160, "stepSize": 0.3}, patience=10)
    kept = fitted.model.stages[-1].getNumTrees
    losses = [(i + 1, loss, i + 1 == fitted.best_round, kept) for i, loss in enumerate(fitted.losses)]
    return spark.createDataFrame(losses, "round int, loss double, chosen boolean, rounds_kept int")


@query()
def search_ada(spark, sf):
    """Cross-validated accuracy of every setting of the stump grid."""
    _, results = search_stumps(fx.features(spark, sf))
    return spark.createDataFrame(
        [(r["n_estimators"], r["learning_rate"], float(r["accuracy"])) for r in results],
        "n_estimators int, learning_rate double, accuracy double",
    )


@query()
def search_rf(spark, sf):
    """Cross-validated accuracy of the draws of the randomised forest search."""
    _, results = search_forest(fx.features(spark, sf))
    return spark.createDataFrame(
        [(r["numTrees"], r["maxDepth"], r["minInstancesPerNode"], r["featureSubsetStrategy"], float(r["accuracy"])) for r in results],
        "trees int, depth int, leaf int, features string, accuracy double",
    )


# ---- report bundles ------------------------------------------------------------------------


def _long(frames: dict[str, DataFrame], values: dict[str, str]) -> DataFrame:
    """Rows and the sum of one column of each frame of a bundle."""
    parts = [
        frames[name].agg(
            F.lit(name).alias("frame"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col(c).cast("double")), 3).alias("total")
        )
        for name, c in values.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _long_sql(frames: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS frame, count(*) AS n, round(sum(CAST({c} AS DOUBLE)), 3) AS total FROM ({sql}) q"
        for name, (sql, c) in frames.items()
    )


_LEDGER_FRAMES = {
    "machine_ledger": "n_tasks", "utilization_timeline": "cpu_util", "utilization_long": "machine_id",
    "latest_sample": "active_tasks",
}


@query(_long_sql({name: (ORACLES[name], c) for name, c in _LEDGER_FRAMES.items()}))
def ledger_report(spark, sf):
    frames = reporting.ledger_report(fx.allocations(spark, sf), fx.machines(spark, sf), ct.MONTH_MS)
    return _long(frames, _LEDGER_FRAMES)


_RUN_FRAMES = {
    "run_kpis": "n_failed", "model_comparison": "n_scheduled", "task_distribution": "n_tasks", "risk_summary": "n_high_risk",
    "sla_histogram": "n", "sla_box_stats": "n",
}


@query(_long_sql({name: (ORACLES[name], c) for name, c in _RUN_FRAMES.items()}))
def run_report(spark, sf):
    ledger = ld.machine_ledger(fx.allocations(spark, sf), fx.machines(spark, sf))
    return _long(reporting.run_report(fx.placements(spark, sf), ledger), _RUN_FRAMES)
