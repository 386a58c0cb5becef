"""Quality of a binary classifier from (label, probability) rows.

Frames carry ``y`` (0/1) and ``p`` (double). A row without a probability or a label is
unscored: it is left out of every count, and ``unscored_counts`` tells how many there are. A
null key is a key of its own. Curves are built from one row per distinct
score, so their cost follows the number of scores and not of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berthline.functions.numeric import apply_temperature, binarize, ratio
from berthline.operators.skew import free_nulls, hold_nulls, running_totals, score_buckets
from berthline.session import store

# Threshold grid, temperature grid, clip of the log loss, and rule names.
N_THRESHOLDS = 99
THRESHOLD_LOW, THRESHOLD_HIGH = 0.01, 0.99
N_TEMPERATURES = 91
TEMPERATURE_LOW, TEMPERATURE_HIGH = 0.5, 5.0
LOG_LOSS_CLIP = 2.220446049250313e-16
RULE_RECALL = "max_precision_given_recall"
RULE_F1 = "best_F1_fallback"


def scored(df: DataFrame) -> DataFrame:
    """The rows that have a probability and a label."""
    return df.filter("p IS NOT NULL AND y IS NOT NULL")


def unscored_counts(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rows that the metrics leave out, next to those they count."""
    missing = F.col("p").isNull() | F.col("y").isNull()
    return df.groupBy(*keys).agg(F.count_if(missing).alias("n_unscored"), F.count_if(~missing).alias("n_scored"))


def counts(actual: Column, predicted: Column) -> list[Column]:
    return [
        F.count_if((actual == 0) & (predicted == 0)).alias("tn"),
        F.count_if((actual == 0) & (predicted == 1)).alias("fp"),
        F.count_if((actual == 1) & (predicted == 0)).alias("fn"),
        F.count_if((actual == 1) & (predicted == 1)).alias("tp"),
    ]


def confusion_matrix(df: DataFrame, threshold: float = 0.5, strict: bool = False, keys: list[str] = ()) -> DataFrame:
    """TN, FP, FN, TP at one threshold."""
    return df.groupBy(*keys).agg(*counts(F.col("y"), binarize("p", threshold, strict)))


def quality_columns() -> dict[str, Column]:
    """Accuracy, precision, recall and F1 from tn, fp, fn, tp; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


def classification_metrics(
    df: DataFrame, threshold: float = 0.5, strict: bool = False, keys: list[str] = ()
) -> DataFrame:
    return confusion_matrix(df, threshold, strict, keys).withColumns(quality_columns())


def classification_report(df: DataFrame, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro and weighted averages."""
    matrix = confusion_matrix(df, threshold, strict)

    def per_class(label: str, hit: str, wrong: str, missed: str) -> Column:
        h, w, m = F.col(hit), F.col(wrong), F.col(missed)
        return F.struct(
            F.lit(label).alias("class"), ratio(h, h + w).alias("precision"), ratio(h, h + m).alias("recall"),
            ratio(2 * h, 2 * h + w + m).alias("f1"), (h + m).alias("support"),
        )

    neg, pos = per_class("0", "tn", "fn", "fp"), per_class("1", "tp", "fp", "fn")
    both = matrix.select(neg.alias("neg"), pos.alias("pos"), (F.col("tp") + F.col("tn")).alias("hits"))
    total = F.col("neg.support") + F.col("pos.support")

    def averaged(label: str, weight_neg: Column, weight_pos: Column) -> Column:
        def mean(c: str) -> Column:
            return F.col(f"neg.{c}") * weight_neg + F.col(f"pos.{c}") * weight_pos

        return F.struct(
            F.lit(label).alias("class"), mean("precision").alias("precision"), mean("recall").alias("recall"),
            mean("f1").alias("f1"), total.alias("support"),
        )

    accuracy = ratio(F.col("hits"), total)
    rows = F.array(
        F.col("neg"),
        F.col("pos"),
        F.struct(
            F.lit("accuracy").alias("class"), accuracy.alias("precision"), accuracy.alias("recall"),
            accuracy.alias("f1"), total.alias("support"),
        ),
        averaged("macro avg", F.lit(0.5), F.lit(0.5)),
        averaged("weighted avg", ratio(F.col("neg.support"), total), ratio(F.col("pos.support"), total)),
    )
    return both.select(F.explode(rows).alias("r")).select("r.*")


def score_counts(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Positives and negatives at each distinct score."""
    return scored(df).groupBy(*keys, "p").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )


def cumulative_confusion(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """True and false positives when everything from a score upward counts as positive."""
    return free_nulls(_cumulate(score_counts(hold_nulls(df, keys), keys), list(keys)), keys)


def _cumulate(counted: DataFrame, keys: list[str]) -> DataFrame:
    down = counted.withColumn("_down", -F.col("p"))
    return running_totals(
        down, keys, "_down", {"tp": "pos", "fp": "neg"}, score_buckets(F.col("_down"))
    ).drop("_down")


def _areas(counted: DataFrame, keys: list[str]) -> DataFrame:
    """roc_auc and average_precision per key from a stored table of score counts."""
    # trapezoid between neighbouring scores: width = negatives here, height = mean true positives
    area = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    steps = _cumulate(counted, keys).groupBy(*keys).agg(
        area.alias("_area"), F.sum(precision * F.col("pos")).alias("_gained"), n_pos.alias("_p"), n_neg.alias("_n")
    )
    return steps.select(
        *keys,
        F.try_divide(F.col("_area"), F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"),
        F.coalesce(F.try_divide(F.col("_gained"), F.col("_p").cast("double")), F.lit(0.0)).alias("average_precision"),
    )


def _counted(df: DataFrame, keys: list[str]) -> DataFrame:
    return store(score_counts(hold_nulls(df, keys), keys), "score-counts")


def roc_auc(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Area under the ROC curve with ties counted half; null when a class is absent."""
    keys = list(keys)
    return free_nulls(_areas(_counted(df, keys), keys).select(*keys, "roc_auc"), keys)


def average_precision(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Step-wise area under precision-recall: sum of precision times recall gained."""
    keys = list(keys)
    return free_nulls(_areas(_counted(df, keys), keys).select(*keys, "average_precision"), keys)


def log_loss_of(y: Column, p: Column) -> Column:
    q = F.greatest(F.lit(LOG_LOSS_CLIP), F.least(F.lit(1.0 - LOG_LOSS_CLIP), p))
    loss = F.when(y == 1, -F.log(q)).otherwise(-F.log(F.lit(1.0) - q))
    return F.avg(loss)


def log_loss(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Mean negative log-likelihood."""
    return scored(df).groupBy(*keys).agg(log_loss_of(F.col("y"), F.col("p")).alias("log_loss"))


def threshold_grid() -> list[float]:
    step = (THRESHOLD_HIGH - THRESHOLD_LOW) / (N_THRESHOLDS - 1)
    return [THRESHOLD_LOW + k * step for k in range(N_THRESHOLDS)]


def thresholds_reached(p: Column) -> Column:
    """How many thresholds of the grid are at or below p: a computed guess, corrected by one step."""
    low, step = F.lit(THRESHOLD_LOW), F.lit((THRESHOLD_HIGH - THRESHOLD_LOW) / (N_THRESHOLDS - 1))
    guess = F.floor((p - low) / step)
    after = F.when(low + (guess + 1) * step <= p, F.lit(1)).otherwise(0)
    before = F.when(low + guess * step > p, F.lit(1)).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(N_THRESHOLDS), guess + 1 + after - before)).cast("int")


def threshold_sweep(df: DataFrame) -> DataFrame:
    """Confusion counts and metrics at every threshold of the grid, from one pass over the rows.

    Each row is reduced to the number of thresholds it reaches; at most 100 groups remain
    and are summed from the top.
    """
    groups = scored(df).withColumn("reached", thresholds_reached(F.col("p"))).groupBy("reached").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    grid = F.array(*[F.lit(t) for t in threshold_grid()])
    ladder = groups.agg(F.collect_list(F.struct("reached", "pos", "neg")).alias("g"))

    def above(i: Column, field: str) -> Column:
        return F.aggregate(
            "g", F.lit(0).cast("bigint"),
            lambda acc, s: acc + F.when(s["reached"] > i, s[field]).otherwise(F.lit(0).cast("bigint")),
        )

    def below(i: Column, field: str) -> Column:
        return F.aggregate(
            "g", F.lit(0).cast("bigint"),
            lambda acc, s: acc + F.when(s["reached"] <= i, s[field]).otherwise(F.lit(0).cast("bigint")),
        )

    numbered = ladder.select("g", F.posexplode(grid).alias("i", "threshold"))
    matrix = numbered.select(
        "threshold",
        below(F.col("i"), "neg").alias("tn"), above(F.col("i"), "neg").alias("fp"),
        below(F.col("i"), "pos").alias("fn"), above(F.col("i"), "pos").alias("tp"),
    )
    return matrix.withColumns(quality_columns())


def pick_threshold(df: DataFrame, recall_target: float = 0.9) -> DataFrame:
    """Most precise threshold that keeps the wanted recall, else the best F1; names its rule.

    Ties go to higher recall, then F1, then the lower threshold; the fallback takes the
    first best F1.
    """
    sweep = threshold_sweep(df)
    enough = F.col("recall") >= F.lit(recall_target)
    order = F.when(
        enough, F.struct(F.lit(1).alias("a"), F.col("precision").alias("b"), F.col("recall").alias("c"),
                         F.col("f1").alias("d"), (-F.col("threshold")).alias("e"))
    ).otherwise(
        F.struct(F.lit(0).alias("a"), F.col("f1").alias("b"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d"),
                 (-F.col("threshold")).alias("e"))
    )
    best = sweep.withColumn("rule", F.when(enough, F.lit(RULE_RECALL)).otherwise(F.lit(RULE_F1)))
    return best.agg(F.max_by(F.struct(*best.columns), order).alias("r")).select("r.*")


def temperature_grid() -> list[float]:
    step = (TEMPERATURE_HIGH - TEMPERATURE_LOW) / (N_TEMPERATURES - 1)
    return [TEMPERATURE_LOW + k * step for k in range(N_TEMPERATURES)]


def temperature_sweep(df: DataFrame) -> DataFrame:
    """Log loss at every temperature of the grid, computed on distinct scores."""
    grid = F.array(*[F.lit(t) for t in temperature_grid()])
    tried = score_counts(df).withColumn("temperature", F.explode(grid))
    q = apply_temperature("p", F.col("temperature"))
    q = F.greatest(F.lit(LOG_LOSS_CLIP), F.least(F.lit(1.0 - LOG_LOSS_CLIP), q))
    loss = F.sum(-F.log(q) * F.col("pos") - F.log(F.lit(1.0) - q) * F.col("neg"))
    return tried.groupBy("temperature").agg((loss / F.sum(F.col("pos") + F.col("neg"))).alias("log_loss"))


def fit_temperature(df: DataFrame) -> DataFrame:
    """Temperature with the smallest log loss; the lowest one on ties."""
    return temperature_sweep(df).agg(
        F.min_by("temperature", F.struct(F.round("log_loss", 12), "temperature")).alias("temperature"),
        F.min("log_loss").alias("log_loss"),
    )


def class_balance(df: DataFrame, label: str = "y") -> DataFrame:
    """Positives, negatives and the weight that balances the positives."""
    return df.agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    ).withColumn(
        "pos_weight",
        F.when(F.col("n_pos") > 0, F.col("n_neg") / F.greatest(F.lit(1), F.col("n_pos"))).otherwise(1.0),
    )


def evaluate_report(df: DataFrame, threshold: float = 0.5, keys: list[str] = ()) -> DataFrame:
    """Confusion counts, metrics, AUC and average precision, per key (for example per split).

    The rows are read once, for the counts at each distinct score; all else follows from those.
    """
    keys = list(keys)
    counted = _counted(df, keys)
    positive = binarize("p", threshold) == 1

    def total(count: str, predicted: Column) -> Column:
        return F.coalesce(F.sum(F.when(predicted, F.col(count)).otherwise(0)), F.lit(0)).cast("bigint")

    matrix = counted.groupBy(*keys).agg(
        total("neg", ~positive).alias("tn"), total("neg", positive).alias("fp"),
        total("pos", ~positive).alias("fn"), total("pos", positive).alias("tp"),
    )
    base = matrix.withColumns({**quality_columns(), "threshold": F.lit(float(threshold))})
    areas = _areas(counted, keys)
    joined = base.join(areas, keys) if keys else base.withColumns(
        {c: areas.select(c).scalar() for c in ("roc_auc", "average_precision")}
    )
    return free_nulls(joined, keys)
