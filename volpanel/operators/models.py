"""Walk-forward event models: out-of-fold scores, calibration, acceptance, judgments.

Every fit sees at most 1,260 rows. Prediction rows are grouped into blocks of
consecutive label ranks and each block receives the training rows its
predictions can reach, so blocks are independent tasks however long a ledger is.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel import params as P
from volpanel.functions.num import add
from volpanel.operators import bootstrap as Bo
from volpanel.operators import series as S
from volpanel.operators.events import OBSERVED, ROW, base_rates
from volpanel.operators.market import UNIVERSE

DEFAULT = P.ModelParams()
SEEDS = {e.event_id: e.seed for e in P.EVENTS}
HORIZONS = {e.event_id: e.horizon for e in P.EVENTS}
#: A fit counts if no part of the gradient of its loss per row is larger.
TOLERANCE = 1e-9


def _probability(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float) -> np.ndarray | None:
    """L2 logistic weights, intercept last and unpenalised, by damped Newton; None if the gradient does not vanish."""
    design = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(design.shape[1], 1.0 / c)
    ridge[-1] = 0.0
    beta = np.zeros(design.shape[1])

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float(np.sum(np.logaddexp(0.0, z) - y * z) + 0.5 * np.sum(ridge * b * b))

    value = loss(beta)
    for _ in range(100):
        p = _probability(design @ beta)
        gradient = design.T @ (p - y) + ridge * beta
        hessian = (design * (p * (1.0 - p))[:, None]).T @ design + np.diag(ridge + 1e-12)
        step = np.linalg.solve(hessian, gradient)
        scale = 1.0
        while scale > 1e-6 and loss(beta - scale * step) > value + 1e-12:
            scale *= 0.5
        beta = beta - scale * step
        value = loss(beta)
        if np.max(np.abs(scale * step)) < 1e-11:
            break
    rest = design.T @ (_probability(design @ beta) - y) + ridge * beta
    return beta if np.max(np.abs(rest)) <= TOLERANCE * max(len(y), 1) else None


def fit_platt(scores: np.ndarray, labels: np.ndarray, ridge: float = 1e-6) -> tuple[float, float] | None:
    """Slope (not below zero) and intercept of the calibration curve; None if the gradient does not vanish."""
    if not len(scores) or not np.isfinite(scores).all() or not np.isfinite(labels).all():
        return None

    def solve(design: np.ndarray, beta: np.ndarray) -> np.ndarray | None:
        n = len(design)
        for _ in range(200):
            p = _probability(design @ beta)
            gradient = design.T @ (p - labels) / n + 2 * ridge * beta
            hessian = (design * (p * (1 - p))[:, None]).T @ design / n + 2 * ridge * np.eye(len(beta))
            step = np.linalg.solve(hessian, gradient)
            largest = np.max(np.abs(step))
            beta = beta - (step if largest <= 5 else step * 5 / largest)
            if largest < 1e-12:
                break
        rest = design.T @ (_probability(design @ beta) - labels) / n + 2 * ridge * beta
        return beta if np.max(np.abs(rest)) <= TOLERANCE else None

    ones = np.ones(len(scores))
    curve = solve(np.column_stack([scores, ones]), np.array([1.0, 0.0]))
    if curve is not None and curve[0] < 0:
        level = solve(ones[:, None], np.array([0.0]))
        curve = None if level is None else np.array([0.0, level[0]])
    return None if curve is None else (float(curve[0]), float(curve[1]))


def _hash(payload: dict) -> str:
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def _in_blocks(df: DataFrame, rank: str, reach: int, block: int) -> DataFrame:
    """Copy each row to its own block and to the later blocks that look back at it."""
    return add(df, {"_block": f"explode(sequence({rank} div {block}, ({rank} + {reach}) div {block}))"})


def out_of_fold_scores(ledger: DataFrame, params: P.ModelParams = DEFAULT) -> DataFrame:
    """One walk-forward logistic fit per labelled row on the labels matured before it.

    Every fit starts from zero, so it does not depend on how rows fall into blocks. Its weights and its training
    window (ranks of labels, from and to) come along; ``logistic_certificates`` proves them. Fits that do not converge
    have no row.
    """
    labelled = ledger.filter(OBSERVED)
    labelled = add(labelled, {"_rank": S.position(S.by(ROW, "prediction_position"))})
    reach = params.maximum_training + max(HORIZONS.values())
    spread = _in_blocks(labelled, "_rank", reach, params.block).select(
        *ROW, "_block", "_rank", "prediction_date", "prediction_position", "target_end_position", "horizon", "label", "predictors"
    )
    schema = (
        f"{UNIVERSE} string, event_id string, prediction_date date, prediction_position long, target_end_position long, "
        "decision_score double, uncalibrated_probability double, base_rate_at_prediction double, label int, "
        "training_sample_size int, training_positive_count int, model_artifact_id string, training_first long, training_last long, "
        "model_weights array<double>"
    )

    def fit_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank", kind="stable").reset_index(drop=True)
        block = int(pdf["_block"].iloc[0])
        x = np.stack(pdf["predictors"].to_numpy()).astype(float)
        y = pdf["label"].to_numpy(dtype=float)
        position = pdf["prediction_position"].to_numpy()
        first = int(np.searchsorted(pdf["_rank"].to_numpy(), block * params.block))
        horizon = int(pdf["horizon"].iloc[0])
        rank = pdf["_rank"].to_numpy()
        out = []
        for i in range(first, len(pdf)):
            stop = int(np.searchsorted(position, position[i] - horizon, side="right"))
            start = max(0, stop - params.maximum_training)
            n, positive = stop - start, int(y[start:stop].sum())
            if n < params.minimum_training or positive < params.minimum_positive or n - positive < params.minimum_negative:
                continue
            beta = fit_logistic(x[start:stop], y[start:stop], params.inverse_penalty)
            if beta is None:
                continue
            score = float(x[i] @ beta[:-1] + beta[-1])
            recent = y[max(start, stop - params.base_rate_rows) : stop]
            row = pdf.iloc[i]
            artifact = {
                "event_id": row["event_id"],
                "first_training": str(pdf["prediction_date"].iloc[start]),
                "last_training": str(pdf["prediction_date"].iloc[stop - 1]),
                "rows": n,
                "weights": [round(float(b), 9) for b in beta],
            }
            out.append(
                (
                    row[UNIVERSE], row["event_id"], row["prediction_date"], int(position[i]), int(row["target_end_position"]),
                    score, float(_probability(np.array(score))), (float(recent.sum()) + 1.0) / (len(recent) + 2.0),
                    int(y[i]), n, positive, _hash(artifact), int(rank[start]), int(rank[stop - 1]), beta.tolist(),
                )
            )
        return pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in schema.split(",")])

    return spread.groupBy(*ROW, "_block").applyInPandas(fit_block, schema)


def sequential_calibration(oof: DataFrame, params: P.ModelParams = DEFAULT) -> DataFrame:
    """Platt curve of each score from the latest matured scores before it."""
    need = params.calibration_rows
    ranked = add(oof, {"_rank": S.position(S.by(ROW, "prediction_position"))})
    spread = _in_blocks(ranked, "_rank", need + max(HORIZONS.values()), params.block)
    added = [
        T.StructField("calibration_sample_size", T.IntegerType()),
        T.StructField("calibration_positive_count", T.IntegerType()),
        T.StructField("calibration_success", T.BooleanType()),
        T.StructField("platt_a", T.DoubleType()),
        T.StructField("platt_b", T.DoubleType()),
        T.StructField("calibrated_probability", T.DoubleType()),
        T.StructField("calibration_first", T.LongType()),
        T.StructField("calibration_last", T.LongType()),
    ]
    schema = T.StructType(list(oof.schema.fields) + added)
    names = list(schema.names)

    def fit_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank", kind="stable").reset_index(drop=True)
        first = int(np.searchsorted(pdf["_rank"].to_numpy(), int(pdf["_block"].iloc[0]) * params.block))
        score, label = pdf["decision_score"].to_numpy(), pdf["label"].to_numpy(dtype=float)
        ends, position, rank = (pdf[c].to_numpy() for c in ("target_end_position", "prediction_position", "_rank"))
        rows = []
        for i in range(first, len(pdf)):
            stop = min(int(np.searchsorted(ends, position[i], side="right")), i)
            start = max(0, stop - need)
            n, positive = stop - start, int(label[start:stop].sum())
            enough = n == need and min(positive, n - positive) >= params.calibration_minimum_class
            curve = fit_platt(score[start:stop], label[start:stop]) if enough else None
            if curve is None:
                rows.append((n, positive, False, None, None, None, None, None))
            else:
                p = float(np.clip(_probability(np.array(curve[0] * score[i] + curve[1])), 1e-6, 1 - 1e-6))
                rows.append((n, positive, True, curve[0], curve[1], p, int(rank[start]), int(rank[stop - 1])))
        out = pdf.iloc[first:].reset_index(drop=True)
        fresh = pd.DataFrame(rows, columns=[f.name for f in added], dtype=object)
        return pd.concat([out, fresh], axis=1)[names]

    return spread.groupBy(*ROW, "_block").applyInPandas(fit_block, schema)


# ---- certificates -----------------------------------------------------------------


def _ranked(rows: DataFrame) -> DataFrame:
    return add(rows, {"_rank": S.position(S.by(ROW, "prediction_position"))})


def logistic_certificates(ledger: DataFrame, scores: DataFrame, params: P.ModelParams = DEFAULT) -> DataFrame:
    """What proves each out-of-fold fit, taken from the ledger alone: the rows and positives of its training window,
    the largest part of its gradient at the published weights, and the score that the weights give its own row.

    The loss is convex, so a zero gradient is the optimum, whoever found it.
    """
    labelled = _ranked(ledger.filter(OBSERVED)).select(*ROW, "_rank", "prediction_position", "label", "predictors")
    dot = "aggregate(zip_with(predictors, slice(model_weights, 1, size(predictors)), (x, w) -> x * w), element_at(model_weights, -1), (a, v) -> a + v)"
    window = scores.selectExpr(*ROW, "prediction_position AS _at", "model_weights", "explode(sequence(training_first, training_last)) AS _rank")
    rows = add(window.join(labelled, [*ROW, "_rank"]), {"_error": f"1D / (1D + exp(-({dot}))) - label"})
    width = max(len(e.predictors) for e in P.EVENTS)
    sums = rows.groupBy(*ROW, F.col("_at").alias("prediction_position")).agg(
        F.expr("count(1) AS training_rows"), F.expr("sum(label) AS training_positive"), F.expr("any_value(model_weights) AS _w"),
        F.expr("abs(sum(_error)) AS _g"), *[F.expr(f"sum(_error * get(predictors, {i})) AS _g{i}") for i in range(width)],
    )
    parts = ", ".join(f"abs(_g{i} + get(_w, {i}) / {params.inverse_penalty}D)" for i in range(width))
    own = scores.join(labelled.select(*ROW, "prediction_position", "predictors"), [*ROW, "prediction_position"])
    own = add(own, {"score_residual": f"decision_score - ({dot})"}).select(*ROW, "prediction_position", "score_residual")
    out = add(sums, {"gradient": f"greatest(_g, {parts})"}).join(own, [*ROW, "prediction_position"])
    return out.select(*ROW, "prediction_position", "training_rows", "training_positive", "gradient", "score_residual")


def calibration_certificates(oof: DataFrame, calibrated: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """As ``logistic_certificates``, for the calibration curves: gradient by intercept and by slope.

    A slope is not below zero; where it is zero, its gradient must only not be negative.
    """
    scored = _ranked(oof).select(*ROW, "_rank", "decision_score", "label")
    fitted = calibrated.filter("calibration_success")
    window = fitted.selectExpr(*ROW, "prediction_position", "platt_a", "platt_b", "explode(sequence(calibration_first, calibration_last)) AS _rank")
    rows = add(window.join(scored, [*ROW, "_rank"]), {"_error": "1D / (1D + exp(-(platt_a * decision_score + platt_b))) - label"})
    sums = rows.groupBy(*ROW, "prediction_position").agg(
        F.expr("count(1) AS calibration_rows"), F.expr("sum(label) AS calibration_positive"), F.expr("any_value(platt_a) AS _a"), F.expr("any_value(platt_b) AS _b"),
        F.expr("avg(_error) AS _gb"), F.expr("avg(_error * decision_score) AS _ga"),
    )
    slope = f"CASE WHEN _a > 0 THEN abs(_ga + {2 * ridge!r}D * _a) ELSE greatest(-_ga, 0D) END"
    out = add(sums, {"intercept_gradient": f"abs(_gb + {2 * ridge!r}D * _b)", "slope_gradient": slope})
    return out.drop("_a", "_b", "_ga", "_gb")


# ---- acceptance -----------------------------------------------------------------


def log_loss(p: str, y: str) -> str:
    q = f"least(greatest({p}, 1e-6), 1D - 1e-6)"
    return f"avg(-({y} * ln({q}) + (1 - {y}) * ln(1D - {q})))"


def brier(p: str, y: str) -> str:
    return f"avg(pow({p} - {y}, 2))"


def latest_rows(df: DataFrame, rows: int = 252) -> DataFrame:
    """The latest rows of each event, in prediction order."""
    newest = f"row_number() OVER (PARTITION BY {', '.join(ROW)} ORDER BY prediction_position DESC)"
    return add(df, {"_recent": newest}).filter(f"_recent <= {rows}").drop("_recent")


def calibration_error(df: DataFrame, p: str, bins: int = 5) -> DataFrame:
    """Expected calibration error over equal-count bins ordered by (p, date)."""
    tile = f"ntile({bins}) OVER (PARTITION BY {', '.join(ROW)} ORDER BY {p}, prediction_date, prediction_position)"
    binned = add(df, {"_bin": tile}).groupBy(*ROW, "_bin").agg(
        F.expr("count(1) AS n"), F.expr(f"abs(avg({p}) - avg(label)) AS gap")
    )
    return binned.groupBy(*ROW).agg(F.expr("sum(n * gap) / sum(n) AS ece"))


def block_bootstrap(df: DataFrame, p: str, base: str, *, replicates: int = 5000, draws: Bo.Draws = Bo.seeded) -> DataFrame:
    """Paired moving-block bootstrap of the Brier skill, seeded per event.

    The input is the fixed-size evaluation window of each event. Its squared errors become prefix sums; a replicate
    draws the starts of its blocks, and a block is a difference of two prefix sums. The last block is cut to the size.
    """
    listed = "sort_array(collect_list(struct(prediction_position AS at, double({0}) AS p, double(label) AS y)))".format
    errors = "transform({0}, e -> (e.p - e.y) * (e.p - e.y))".format
    held = df.groupBy(*ROW).agg(
        F.count("*").alias("rows"), *[F.expr(f"{Bo.running(errors(listed(c)))} AS {n}") for c, n in ((p, "_model"), (base, "_naive"))]
    )
    lengths = ", ".join(f"'{e}', {h}" for e, h in HORIZONS.items())
    seeds = ", ".join(f"'{e}', {s}" for e, s in SEEDS.items())
    held = add(held, {"length": f"map({lengths})[event_id]", "seed": f"map({seeds})[event_id]"})
    held = add(held, {"slots": "bigint(ceil(rows / length))", "n": "rows - length + 1"})
    drawn = draws(held.select(*ROW, "n", "slots", "seed"), ROW, replicates).join(held, ROW)
    cut = "rows - (slots - 1) * length"  # rows of the last block
    block = "{0}[int(i) + length] - {0}[int(i)]".format
    last = "{0}[int(picks[int(slots) - 1]) + length] - {0}[int(picks[int(slots) - 1]) + int({1})]".format
    sums = {c: f"{Bo.total(block(c))} - ({last(c, cut)})" for c in ("_model", "_naive")}
    skill = add(drawn, {"skill": f"1D - try_divide({sums['_model']}, {sums['_naive']})"})
    return skill.groupBy(*ROW).agg(F.expr("percentile(skill, 0.05) AS skill_lower"), F.expr("percentile(skill, 0.95) AS skill_upper"))


def probability_scores(df: DataFrame, p: str, base: str) -> DataFrame:
    """Brier, skill and log loss of a probability against a base rate."""
    out = df.groupBy(*ROW).agg(
        F.expr("count(1) AS samples"),
        F.expr("sum(label) AS positives"),
        F.expr(f"{brier(p, 'label')} AS brier_model"),
        F.expr(f"{brier(base, 'label')} AS brier_base"),
        F.expr(f"{log_loss(p, 'label')} AS log_loss_model"),
        F.expr(f"{log_loss(base, 'label')} AS log_loss_base"),
    )
    return add(out, {"negatives": "samples - positives", "brier_skill": "1D - try_divide(brier_model, brier_base)"})


def acceptance_metrics(calibrated: DataFrame, params: P.ModelParams = DEFAULT) -> DataFrame:
    """Gate per event on the latest calibrated rows; events without any get a row too."""
    need = params.calibration_rows
    recent = latest_rows(calibrated.filter("calibration_success"), need)
    p, base = "calibrated_probability", "base_rate_at_prediction"
    scores = probability_scores(recent, p, base)
    full = recent.join(scores.filter(f"samples = {need} AND brier_base > 0").select(*ROW), ROW, "left_semi")
    out = scores.join(calibration_error(full, p), ROW, "left").join(block_bootstrap(full, p, base), ROW, "left")
    universes = calibrated.select(UNIVERSE).distinct()
    grid = add(universes, {"event_id": "explode(array(" + ", ".join(f"'{e.event_id}'" for e in P.EVENTS) + "))"})
    out = grid.join(out, ROW, "left")
    few = f"least(positives, negatives) < {params.calibration_minimum_class}"
    out = add(
        out,
        {
            "samples": "coalesce(samples, 0L)",
            "reason": f"CASE WHEN coalesce(samples, 0L) < {need} THEN 'INSUFFICIENT_CALIBRATED_OOF' "
            f"WHEN {few} THEN 'INSUFFICIENT_CLASSES' WHEN brier_base <= 0 THEN 'ZERO_BASE_BRIER' END",
        },
    )
    gate = "brier_skill >= 0.02D AND log_loss_model <= log_loss_base AND ece <= 0.08D AND skill_lower > -0.02D"
    return add(out, {"accepted": f"reason IS NULL AND coalesce({gate}, false)"})


def fit_current(
    ledger: DataFrame, oof: DataFrame, metrics: DataFrame, params: P.ModelParams = DEFAULT
) -> DataFrame:
    """Probability of the latest session for events whose history was accepted.

    Training and calibration rows are cut to their fixed sizes before they are
    brought together, so a group holds at most 1,260 + 252 rows.
    """
    w = f"PARTITION BY {', '.join(ROW)}"
    df = ledger.join(metrics.filter("accepted").select(*ROW), ROW, "left_semi")
    df = add(df, {"_now": f"max(prediction_position) OVER ({w})"})
    now = df.filter("prediction_position = _now AND event_status = 'ELIGIBLE'").selectExpr(
        *ROW, "prediction_position AS _now", "predictors AS _x"
    )
    training = df.filter(f"{OBSERVED} AND target_end_position <= _now AND prediction_position < _now")
    training = latest_rows(training, params.maximum_training)
    training = training.join(now, [*ROW, "_now"]).select(*ROW, "prediction_date", "prediction_position", "label", "predictors", "_x")
    scores = oof.join(now.select(*ROW, "_now"), ROW)
    scores = latest_rows(
        scores.filter("prediction_position < _now AND target_end_position <= _now"), params.calibration_rows
    ).select(*ROW, "prediction_position", "decision_score", "label")
    schema = (
        f"{UNIVERSE} string, event_id string, probability double, training_sample_size int, "
        "training_positive_count int, model_artifact_id string"
    )
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def fit(rows: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=columns)
        if rows.empty or len(past) != params.calibration_rows:
            return empty
        rows = rows.sort_values("prediction_position", kind="stable")
        past = past.sort_values("prediction_position", kind="stable")
        y, seen = rows["label"].to_numpy(dtype=float), past["label"].to_numpy(dtype=float)
        n, positive, hits = len(y), int(y.sum()), int(seen.sum())
        if n < params.minimum_training or positive < params.minimum_positive or n - positive < params.minimum_negative:
            return empty
        if min(hits, len(seen) - hits) < params.calibration_minimum_class:
            return empty
        curve = fit_platt(past["decision_score"].to_numpy(dtype=float), seen)
        if curve is None:
            return empty
        beta = fit_logistic(np.stack(rows["predictors"].to_numpy()).astype(float), y, params.inverse_penalty)
        if beta is None:
            return empty
        score = float(np.asarray(rows["_x"].iloc[0], dtype=float) @ beta[:-1] + beta[-1])
        p = float(np.clip(_probability(np.array(curve[0] * score + curve[1])), 1e-6, 1 - 1e-6))
        artifact = _hash(
            {
                "event_id": rows["event_id"].iloc[0],
                "first_training": str(rows["prediction_date"].iloc[0]),
                "last_training": str(rows["prediction_date"].iloc[-1]),
                "rows": n,
                "weights": [round(float(b), 9) for b in beta],
                "platt": [round(c, 9) for c in curve],
            }
        )
        return pd.DataFrame([(rows[UNIVERSE].iloc[0], rows["event_id"].iloc[0], p, n, positive, artifact)], columns=columns)

    fitted = training.groupBy(*ROW).cogroup(scores.groupBy(*ROW)).applyInPandas(fit, schema)
    return fitted.join(metrics.select(*ROW, "accepted", "brier_skill", "ece"), ROW)


# ---- judgments --------------------------------------------------------------------

INTERPRETATIONS = {
    # The published sentence of each kind of judgment.
    "NOT_APPLICABLE": "当前状态不适用该转移问题",
    "UNOBSERVABLE": "当前输入不足，无法观察该问题",
    "INSUFFICIENT_HISTORY": "同类完整样本不足，暂不发布历史基准",
    "BASE_RATE_ONLY": "当前仅显示同类历史发生率；特征模型尚无已验收增量判断",
    "MUCH_HIGHER": "特征条件概率明显高于同类历史基准",
    "HIGHER": "特征条件概率略高于同类历史基准",
    "LOWER": "特征条件概率低于同类历史基准",
    "EQUAL": "特征条件概率与同类历史基准一致",
}


def judgments(
    ledger: DataFrame,
    accepted: DataFrame | None = None,
    *,
    minimum_samples: int = 252,
    maximum_samples: int = 504,
) -> DataFrame:
    """Published judgment per (universe, session, event).

    ``accepted`` holds the current fit of accepted events; it applies to the
    latest session only.
    """
    df = base_rates(ledger, minimum_samples=minimum_samples, maximum_samples=maximum_samples)
    empty = "_p double, _n int, _pos int, _skill double, _ece double"
    if accepted is None:
        df = add(df, {c.split()[0]: f"CAST(NULL AS {c.split()[1]})" for c in empty.split(", ")})
    else:
        latest = f"max(prediction_position) OVER (PARTITION BY {UNIVERSE})"
        model = accepted.selectExpr(
            *ROW, "probability AS _p", "training_sample_size AS _n", "training_positive_count AS _pos",
            "brier_skill AS _skill", "ece AS _ece",
        )
        df = add(df, {"_latest": f"prediction_position = {latest}"}).join(model, ROW, "left")
        df = add(df, {c: f"CASE WHEN _latest THEN {c} END" for c in ("_p", "_n", "_pos", "_skill", "_ece")}).drop("_latest")
    df = add(
        df,
        {
            "model_status": "CASE WHEN event_status <> 'ELIGIBLE' THEN 'NOT_RUN' WHEN base_rate IS NULL THEN 'INSUFFICIENT_HISTORY' "
            "WHEN _p IS NOT NULL THEN 'CALIBRATED_MODEL' ELSE 'BASE_RATE_ONLY' END"
        },
    )
    calibrated, known = "model_status = 'CALIBRATED_MODEL'", "model_status IN ('CALIBRATED_MODEL', 'BASE_RATE_ONLY')"
    asked = "event_status = 'ELIGIBLE'"
    df = add(df, {"uplift": f"CASE WHEN {calibrated} THEN _p - base_rate WHEN model_status = 'BASE_RATE_ONLY' THEN 0D END"})
    t = INTERPRETATIONS
    text = (
        f"CASE WHEN {calibrated} THEN CASE WHEN uplift >= 0.1D THEN '{t['MUCH_HIGHER']}' WHEN uplift > 0 THEN '{t['HIGHER']}' "
        f"WHEN uplift < 0 THEN '{t['LOWER']}' ELSE '{t['EQUAL']}' END "
        f"WHEN event_status = 'NOT_APPLICABLE' THEN '{t['NOT_APPLICABLE']}' WHEN event_status = 'UNOBSERVABLE' THEN '{t['UNOBSERVABLE']}' "
        f"WHEN model_status = 'INSUFFICIENT_HISTORY' THEN '{t['INSUFFICIENT_HISTORY']}' ELSE '{t['BASE_RATE_ONLY']}' END"
    )
    short = "model_status = 'INSUFFICIENT_HISTORY'"
    return df.selectExpr(
        UNIVERSE,
        "prediction_date AS session_date",
        "prediction_position",
        "event_id",
        "event_status",
        "model_status",
        f"CASE WHEN {calibrated} THEN 'FEATURE_CONDITIONAL' WHEN {known} THEN 'HISTORICAL_REFERENCE' END AS probability_kind",
        f"CASE WHEN {calibrated} THEN _p WHEN {known} THEN base_rate END AS probability",
        f"CASE WHEN {known} THEN base_rate END AS base_rate",
        "uplift",
        f"CASE WHEN {asked} THEN target_window_end_session END AS target_window_end_session",
        f"CASE WHEN {asked} THEN base_rate_sample_size END AS base_rate_sample_size",
        f"CASE WHEN {asked} THEN base_rate_positive_count END AS base_rate_positive_count",
        f"CASE WHEN {short} THEN 0 WHEN {known} THEN _n END AS training_sample_size",
        f"CASE WHEN {short} THEN 0 WHEN {known} THEN _pos END AS training_positive_count",
        f"CASE WHEN {known} THEN _skill END AS brier_skill",
        f"CASE WHEN {known} THEN _ece END AS ece",
        f"{text} AS interpretation",
    )


def outlook(judged: DataFrame, state: DataFrame) -> DataFrame:
    """Best supported event of each session, or why there is none."""
    order = "CASE event_id " + " ".join(f"WHEN '{e.event_id}' THEN {i}" for i, e in enumerate(P.EVENTS)) + " END"
    summary = judged.groupBy(UNIVERSE, "session_date").agg(
        F.expr("bool_or(event_status = 'ELIGIBLE') AS _eligible"),
        F.expr("bool_or(event_status = 'UNOBSERVABLE') AS _hidden"),
        F.expr("bool_and(event_status = 'NOT_APPLICABLE') AS _none"),
        F.expr("bool_or(model_status = 'BASE_RATE_ONLY') AS _base"),
        F.expr(
            f"max(CASE WHEN model_status = 'CALIBRATED_MODEL' THEN struct(uplift, -({order}) AS o, event_id) END) AS _best"
        ),
    )
    out = state.select(UNIVERSE, "session_date", "data_status").join(summary, [UNIVERSE, "session_date"], "left")
    return add(
        out,
        {
            "outlook_answer": "CASE WHEN data_status <> 'OK' THEN 'UNKNOWN' WHEN NOT _eligible AND _hidden THEN 'UNKNOWN' "
            "WHEN _none THEN 'NOT_APPLICABLE' WHEN _best IS NOT NULL THEN if(_best.uplift >= 0.1D, _best.event_id, 'NO_STRONG_EDGE') "
            "WHEN _base THEN 'BASE_RATE_ONLY' ELSE 'UNKNOWN' END"
        },
    ).select(UNIVERSE, "session_date", "outlook_answer")
