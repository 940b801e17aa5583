"""Usage thresholds, static routing and the adaptive controller."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dualcast.functions.expressions import tie_key
from dualcast.operators.blocks import full_frame, over_history, rows_so_far
from dualcast.operators.ranking import exact_quantiles
from dualcast.session import materialize
from dualcast.settings import BIAS_LIMIT, KEYS, TOLERANCE

FOLD_ROWS = 2_000_000  # distinct scores one controller may hold in one task; brackets narrow until they fit

TRACE_SCHEMA = (
    "dataset_id string, controller string, step long, batch_rows long, simple_count long, "
    "cumulative_simple_count long, cumulative_rows long, bias_before double, effective_threshold double, "
    "bias_after double"
)


def usage_thresholds(df: DataFrame, targets: Sequence[float], score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Linear score quantile per target share and the share it achieves on the same rows."""
    by = list(by)
    array = exact_quantiles(df, by, score, list(targets))
    goals = F.arrays_zip(F.array(*[F.lit(float(t)) for t in targets]).alias("target"), F.col("quantiles").alias("threshold"))
    flat = array.select(*by, F.explode(goals).alias("g")).select(
        *by, F.col("g.target").alias("target"), F.col("g.threshold").alias("threshold")
    )
    # one pass over the scores counts every target: the rows meet the short list of thresholds
    lists = flat.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("target", "threshold"))).alias("_t"))
    rows = df.select(*by, score)
    joined = rows.join(lists, by) if by else rows.withColumn("_t", lists.select("_t").scalar())
    below = [F.avg((F.col(score) < F.col("_t")[i]["threshold"]).cast("double")).alias(f"_a{i}") for i in range(len(targets))]
    counted = joined.groupBy(*by, "_t").agg(F.count(F.lit(1)).alias("rows"), *below)
    entries = F.explode(F.array(*[
        F.struct(
            F.col("_t")[i]["target"].alias("target"), F.col("_t")[i]["threshold"].alias("base_threshold"),
            F.col(f"_a{i}").alias("achieved"),
        ) for i in range(len(targets))
    ]))
    return counted.select(*by, entries.alias("e"), "rows").select(*by, "e.*", "rows").withColumn(
        "violation", F.abs(F.col("achieved") - F.col("target"))
    )


def route_static(df: DataFrame, threshold, score: str = "score", name: str = "use_simple") -> DataFrame:
    """The simple forecast exactly where the score is below the threshold."""
    return df.withColumn(name, F.col(score) < (F.lit(threshold) if isinstance(threshold, float) else threshold))


def relative_step(df: DataFrame, keys: Sequence[str] = KEYS, name: str = "step") -> DataFrame:
    """Rows of the series so far, counted: a gap in its index is no step."""
    return rows_so_far(df, keys, name)


# ---- adaptive controller -------------------------------------------------------------------


def controllers(
    spark, datasets: Sequence[str], base: float, target: float, etas: Sequence[float], bias_limit: float = BIAS_LIMIT
) -> DataFrame:
    """Controller table: one row per (dataset, eta)."""
    rows = [(d, f"eta={e}", float(e), float(target), float(base), float(bias_limit)) for d in datasets for e in etas]
    return spark.createDataFrame(
        rows, "dataset_id string, controller string, eta double, target double, base_threshold double, bias_limit double"
    )


def _fold(steps: pd.DataFrame, setting: dict, start: dict | None) -> tuple[pd.DataFrame, dict | None]:
    """Run one controller over its steps in order.

    A step holds the rows whose score is known to lie below its bracket and the distinct scores inside
    it. The run stops at the first step whose threshold leaves its bracket and returns the state there.
    """
    bias = start["bias"] if start else 0.0
    simple_total = start["simple"] if start else 0
    row_total = start["rows"] if start else 0
    out = []
    for step in steps.itertuples(index=False):
        threshold = min(1.0, max(0.0, setting["base_threshold"] + bias))
        if not step.low <= threshold <= step.high:
            return pd.DataFrame(out), {"step": step.step, "bias": bias, "simple": simple_total, "rows": row_total}
        inside = int(np.searchsorted(step.scores, threshold, side="left"))
        simple = int(step.below + (step.upto[inside - 1] if inside else 0))
        simple_total, row_total = simple_total + simple, row_total + int(step.rows)
        after = bias + setting["eta"] * (setting["target"] - simple / step.rows)
        after = min(setting["bias_limit"], max(-setting["bias_limit"], after))
        out.append((int(step.step), int(step.rows), simple, simple_total, row_total, bias, threshold, after))
        bias = after
    return pd.DataFrame(out), None


_TRACE = [
    "step", "batch_rows", "simple_count", "cumulative_simple_count", "cumulative_rows", "bias_before",
    "effective_threshold", "bias_after",
]


def _guess(steps: pd.DataFrame, setting: dict, start: dict | None) -> list[float]:
    """Approximate threshold path from per-step histograms inside the brackets."""
    bias = start["bias"] if start else 0.0
    path = []
    for step in steps.itertuples(index=False):
        threshold = min(1.0, max(0.0, setting["base_threshold"] + bias))
        path.append(threshold)
        width = (step.high - step.low) / step.bins if step.high > step.low else 1.0
        place = min(max((threshold - step.low) / width, 0.0), float(step.bins))
        whole = np.searchsorted(step.bin, int(place), side="left")
        partial = step.counts[whole] * (place - int(place)) if whole < len(step.bin) and step.bin[whole] == int(place) else 0.0
        share = (step.below + step.counts[:whole].sum() + partial) / step.rows
        bias = min(setting["bias_limit"], max(-setting["bias_limit"], bias + setting["eta"] * (setting["target"] - share)))
    return path


def route_adaptive(
    df: DataFrame,
    settings: DataFrame,
    score: str = "score",
    step: str = "step",
    fold_rows: int = FOLD_ROWS,
    start: dict[tuple[str, str], dict] | None = None,
) -> DataFrame:
    """Controller trace: one row per (dataset, controller, step).

    At each step the threshold is the base plus the bias, clipped to [0, 1]; rows below it take the
    simple forecast; the bias then moves by eta times (target - share), within its limit. The steps
    depend on each other only through that one number, so a task needs the score counts near the
    threshold and nothing else. Each step has a bracket around its threshold, at first all scores;
    histograms narrow the brackets until a controller's scores inside them are at most ``fold_rows``,
    and a run that cannot get there is an error. The exact run then checks every bracket and resumes
    from the last exact state where one was missed, so the result never depends on the brackets.
    """
    rows = df.select("dataset_id", F.col(step).cast("bigint").alias("step"), F.col(score).cast("double").alias("score"))
    # copies of one score become one weighted row before anything is grouped by step
    weighted = rows.groupBy("dataset_id", "step", "score").agg(F.count(F.lit(1)).alias("c"))
    table = [r.asDict() for r in settings.collect()]  # one row per controller
    start = dict(start or {})
    return _narrowing_fold(materialize(weighted), table, start, fold_rows)


def _step_rows(weighted: DataFrame, group: list[str]) -> DataFrame:
    """Per step: rows, rows below the bracket and the sorted distinct scores inside it with running counts."""
    inside = (F.col("score") >= F.col("low")) & (F.col("score") <= F.col("high"))
    return weighted.groupBy(*group, "step", "low", "high").agg(
        F.sum("c").alias("rows"), F.coalesce(F.sum(F.when(F.col("score") < F.col("low"), F.col("c"))), F.lit(0)).alias("below"),
        F.sort_array(F.collect_list(F.when(inside, F.struct("score", "c")))).alias("_in"),
    ).select(
        *group, "step", "low", "high", "rows", "below",
        F.col("_in.score").alias("scores"), F.col("_in.c").alias("counts"),
    )


def _run_fold(per_step: DataFrame, group: list[str], table: list[dict], start: dict) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        pdf["upto"] = [np.cumsum(c) for c in pdf["counts"]]
        parts = []
        for setting in table:
            if setting["dataset_id"] != pdf["dataset_id"].iat[0]:
                continue
            if "controller" in group and setting["controller"] != pdf["controller"].iat[0]:
                continue
            state = start.get((setting["dataset_id"], setting["controller"]))
            todo = pdf[pdf["step"] >= state["step"]] if state else pdf
            trace, missed = _fold(todo, setting, state)
            trace = pd.DataFrame(trace.to_numpy() if len(trace) else np.empty((0, 8)), columns=_TRACE)
            trace["_missed"] = False
            if missed:
                trace.loc[len(trace)] = [missed["step"], 0, 0, missed["simple"], missed["rows"], missed["bias"], 0.0, 0.0, True]
            trace.insert(0, "controller", setting["controller"])
            trace.insert(0, "dataset_id", setting["dataset_id"])
            parts.append(trace)
        out = pd.concat(parts) if parts else pd.DataFrame(columns=["dataset_id", "controller", *_TRACE, "_missed"])
        longs = ["step", "batch_rows", "simple_count", "cumulative_simple_count", "cumulative_rows"]
        return out.astype({**{c: "int64" for c in longs}, "_missed": "bool"})

    return per_step.groupBy(*group).applyInPandas(run, TRACE_SCHEMA + ", _missed boolean")


def _narrowing_fold(weighted: DataFrame, table: list[dict], start: dict, fold_rows: int) -> DataFrame:
    spark = weighted.sparkSession
    group = ["dataset_id", "controller"]
    done: list[DataFrame] = []
    while True:
        # the steps still open per controller, with the widest bracket
        open_from = spark.createDataFrame(
            [(t["dataset_id"], t["controller"], int((start.get((t["dataset_id"], t["controller"])) or {"step": 0})["step"]))
             for t in table], "dataset_id string, controller string, _from long")
        brackets = weighted.select("dataset_id", "step").distinct().join(open_from, "dataset_id").where(
            F.col("step") >= F.col("_from")
        ).select(*group, "step", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
        before = None
        while True:
            placed = weighted.join(brackets, ["dataset_id", "step"])
            inside = (F.col("score") >= F.col("low")) & (F.col("score") <= F.col("high"))
            load = placed.where(inside).groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
            heaviest = load.agg(F.max("n")).first()[0] or 0
            if heaviest <= fold_rows:
                break
            if heaviest == before:
                raise ValueError(f"brackets leave {heaviest} scores of one controller for one task, over its bound of {fold_rows}")
            before = heaviest
            steps = brackets.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
            bins = int(max(8, min(4096, fold_rows // max(steps, 1))))
            narrowed = materialize(_narrow(placed, bins, table, start))
            brackets = narrowed
        trace = materialize(_run_fold(_step_rows(placed, group), group, table, start))
        done.append(trace.where(~F.col("_missed")).drop("_missed"))
        missed = trace.where("_missed").collect()  # at most one row per controller
        if not missed:
            out = done[0]
            for part in done[1:]:
                out = out.unionByName(part)
            return out
        start = {
            (m["dataset_id"], m["controller"]): {
                "step": m["step"], "bias": m["bias_before"], "simple": m["cumulative_simple_count"], "rows": m["cumulative_rows"],
            } for m in missed
        }
        table = [t for t in table if (t["dataset_id"], t["controller"]) in start]


def _narrow(placed: DataFrame, bins: int, table: list[dict], start: dict) -> DataFrame:
    """Brackets of four bins around the approximate path."""
    group = ["dataset_id", "controller"]
    inside = (F.col("score") >= F.col("low")) & (F.col("score") <= F.col("high"))
    span = F.col("high") - F.col("low")
    place = F.when(span > 0, F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("low")) / span * bins))).otherwise(0)
    bin_of = F.when(F.col("score") < F.col("low"), F.lit(-1)).when(inside, place).otherwise(F.lit(bins)).cast("int")
    histogram = placed.groupBy(*group, "step", "low", "high", bin_of.alias("bin")).agg(F.sum("c").alias("count"))
    per_step = histogram.groupBy(*group, "step", "low", "high").agg(
        F.sum("count").alias("rows"), F.coalesce(F.sum(F.when(F.col("bin") < 0, F.col("count"))), F.lit(0)).alias("below"),
        F.sort_array(F.collect_list(F.when(F.col("bin").between(0, bins - 1), F.struct("bin", "count")))).alias("_b"),
    ).select(*group, "step", "low", "high", "rows", "below", F.col("_b.bin").alias("bin"), F.col("_b.count").alias("count"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step").reset_index(drop=True)
        pdf["bins"] = bins
        pdf["bin"] = [np.asarray(b) for b in pdf["bin"]]
        pdf["count"] = [np.asarray(c, dtype=float) for c in pdf["count"]]
        key = (pdf["dataset_id"].iat[0], pdf["controller"].iat[0])
        setting = next(t for t in table if (t["dataset_id"], t["controller"]) == key)
        path = np.array(_guess(pdf.rename(columns={"count": "counts"}), setting, start.get(key)))
        width = (pdf["high"] - pdf["low"]).to_numpy() / bins
        low = np.maximum(pdf["low"].to_numpy(), path - 2 * width)
        high = np.minimum(pdf["high"].to_numpy(), path + 2 * width)
        # a path outside the old bracket keeps a thin bracket there; the exact run will notice and resume
        low, high = np.minimum(low, high), np.maximum(low, high)
        low[path < pdf["low"].to_numpy()] = path[path < pdf["low"].to_numpy()]
        high[path > pdf["high"].to_numpy()] = path[path > pdf["high"].to_numpy()]
        return pdf[["dataset_id", "controller", "step"]].assign(low=low, high=high)

    return per_step.groupBy(*group).applyInPandas(run, "dataset_id string, controller string, step long, low double, high double")


def controller_trace(trace: DataFrame) -> DataFrame:
    """Shares per step and so far."""
    return trace.withColumns({
        "simple_coverage": F.col("simple_count") / F.col("batch_rows"),
        "cumulative_coverage": F.col("cumulative_simple_count") / F.col("cumulative_rows"),
    })


def decision_log(df: DataFrame, trace: DataFrame, score: str = "score", step: str = "step") -> DataFrame:
    """Every routed row with the controller's state before and after its step."""
    states = trace.select(
        "dataset_id", "controller", F.col("step").alias(step), "bias_before", "effective_threshold", "bias_after"
    )
    routed = df.join(states, ["dataset_id", step])
    use = F.col(score) < F.col("effective_threshold")
    chosen = F.when(use, F.col("simple_prediction")).otherwise(F.col("complex_prediction"))
    return routed.withColumns({"use_simple": use, "selected_prediction": chosen}).withColumn(
        "scaled_squared_error",
        F.pow((F.col("y_true") - F.col("selected_prediction")) / F.col("mase_denominator"), F.lit(2.0)),
    )


def step_losses(decisions: DataFrame, step: str = "step") -> DataFrame:
    """Mean scaled loss per controller and step."""
    return decisions.groupBy("dataset_id", "controller", step).agg(F.avg("scaled_squared_error").alias("batch_scaled_loss"))


def rolling_usage(
    trace: DataFrame, rows: int, weighted: bool = True, partial: bool = False,
    keys: Sequence[str] = ("dataset_id", "controller"), step: str = "step",
) -> DataFrame:
    """Share of the simple forecast over the last ``rows`` steps (full frames only unless ``partial``)."""

    def build(blocked, window):
        frame, full = full_frame(window, rows, current=True)
        if weighted:
            share = F.sum("simple_count").over(frame) / F.sum("batch_rows").over(frame)
        else:
            share = F.avg(F.col("simple_count") / F.col("batch_rows")).over(frame)
        return blocked.withColumn("rolling_usage", share if partial else F.when(full, share))

    return over_history(trace, rows - 1 or 1, build, keys, index=step)


def worst_rolling(
    rolled: DataFrame, target: float, keys: Sequence[str] = ("dataset_id", "controller"), weighted: bool = True
) -> DataFrame:
    """Largest gap to the target over full frames; the overall gap where no frame is full."""
    overall = F.sum("simple_count") / F.sum("batch_rows") if weighted else F.avg(F.col("simple_count") / F.col("batch_rows"))
    return rolled.groupBy(*keys).agg(
        F.coalesce(F.max(F.abs(F.col("rolling_usage") - target)), F.abs(overall - F.lit(target))).alias("worst_rolling_violation")
    )


def controller_summary(decisions: DataFrame, trace: DataFrame, target: float, rolling: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Usage, loss and bias of each controller: overall, per series and over steps."""
    by = ["dataset_id", "controller"]
    per_series = decisions.groupBy(*by, *[k for k in keys if k not in by]).agg(
        F.avg("scaled_squared_error").alias("_loss"), F.avg(F.col("use_simple").cast("double")).alias("_use"),
        F.sum("scaled_squared_error").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.count_if("use_simple").alias("_simple"),
    )
    gap = F.abs(F.col("_use") - target)
    overall = F.sum("_simple") / F.sum("_n")
    series = per_series.groupBy(*by).agg(
        overall.alias("achieved_coverage"), F.abs(overall - F.lit(target)).alias("coverage_violation"),
        F.avg("_use").alias("equal_series_coverage"), F.avg(gap).alias("mean_series_violation"),
        F.max(gap).alias("worst_series_violation"), F.avg("_loss").alias("equal_series_loss"),
        (F.sum("_sum") / F.sum("_n")).alias("pooled_loss"), F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("series_count"),
    )
    steps = trace.groupBy(*by).agg(
        F.avg(F.abs(F.col("simple_count") / F.col("batch_rows") - target)).alias("mean_batch_violation"),
        F.max_by("bias_after", "step").alias("final_bias"), F.max(F.abs("bias_before")).alias("maximum_bias"),
        F.count(F.lit(1)).alias("steps"), F.min("batch_rows").alias("minimum_batch_rows"),
        F.max("batch_rows").alias("maximum_batch_rows"),
    )
    return series.join(steps, by).join(worst_rolling(rolling_usage(trace, rolling), target), by)


def select_eta(
    summary: DataFrame, tolerance: float = TOLERANCE, loss: str = "equal_series_loss", short: bool = False
) -> DataFrame:
    """Rank step sizes: feasible ones by loss; when none is feasible, by violation first.

    ``short`` leaves the violation out of the feasible order (the equal-length variant).
    """
    feasible = F.col("coverage_violation") <= tolerance
    any_feasible = F.max(feasible).over(Window.partitionBy("dataset_id"))
    ranked = summary.withColumns({"feasible": feasible, "_any": any_feasible})
    first = [
        F.when(F.col("_any"), ~F.col("feasible")),
        F.when(~F.col("_any"), tie_key("coverage_violation")),
        tie_key(loss), tie_key("worst_rolling_violation"),
    ]
    last = [] if short else [F.when(F.col("_any"), tie_key("coverage_violation"))]
    window = Window.partitionBy("dataset_id").orderBy(*first, *last, F.col("eta"))
    return ranked.withColumn("choice", F.row_number().over(window)).drop("_any")
