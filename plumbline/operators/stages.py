"""After calibration: log-odds offset, thresholds, selection by cross-validation, model wrapper, attributions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import bin_index, clipped, expit, logit
from . import metrics
from .calibrators import BBQ, Beta, Calibrator, CenteredIsotonic, Histogram, Isotonic, Platt, ScalingBinning, Temperature, VennAbers, _logit, _sigma, buffered, folds
from .frame import Frame, S, prefixed
from .solvers import irls, root_1d, together



class LogitOffset:
    """A shift of the log-odds by ``delta``, or by what brings the mean to ``target_mean``; kept apart from the map and auditable."""

    def __init__(self, delta: float | None = None, target_mean: float | None = None):
        if (delta is None) == (target_mean is None):
            raise ValueError("give exactly one of delta and target_mean")
        if target_mean is not None and not 0 < target_mean < 1:
            raise ValueError("the target mean lies strictly between 0 and 1")
        self.delta, self.target = delta, target_mean

    def fit(self, f: Frame) -> LogitOffset:
        z = logit(S())

        def value(d: float):
            q = expit(z + F.lit(float(d)))
            m, slope = f.df.agg(metrics.mean(q), metrics.mean(q * (1 - q))).first()
            return m - self.target, slope

        if self.target is not None:
            self.delta = root_1d(value, 0.0, -40.0, 40.0)
        self.before, self.after = f.df.agg(metrics.mean(S()), metrics.mean(self.predict(S()))).first()
        self.fitted_at = datetime.now(timezone.utc).isoformat()
        return self

    def predict(self, p: Column) -> Column:
        return expit(logit(p) + F.lit(float(self.delta)))

    def _check(self) -> None:
        if not hasattr(self, "before"):
            raise RuntimeError("LogitOffset has not been fitted")

    def affine(self) -> tuple[float, float]:
        return 1.0, float(self.delta)

    def interpret(self, spark: SparkSession) -> DataFrame:
        self._check()
        messages = [
            f"all odds are multiplied by {np.exp(self.delta):.6g}", f"the mean moves from {self.before:.6g} to {self.after:.6g}",
            "a correction of the base rate; the order of the scores stays",
        ]
        rows = [("LogitOffset", "delta", float(self.delta), None)] + [("LogitOffset", None, None, m) for m in messages]
        return spark.createDataFrame(rows, "method string, parameter string, value double, message string")

    def interval_inverse(self, lo: float, hi: float, space: str = "probability", buffer_logit: float = 0.0) -> tuple[float, float]:
        """Raw interval of a calibrated one; every target is attainable unless a buffer empties the interval."""
        self._check()
        lo, hi = buffered(lo, hi, space, buffer_logit)
        z = [-np.inf if lo <= 0 else _logit(lo) - self.delta, np.inf if hi >= 1 else _logit(hi) - self.delta]
        return tuple(z) if space == "logit" else (0.0 if lo <= 0 else _sigma(z[0]), 1.0 if hi >= 1 else _sigma(z[1]))

    def point_inverse(self, p: float) -> float:
        return _sigma(_logit(p) - self.delta)

    def audit(self, f: Frame) -> dict:
        after = Frame(f.df.withColumn("s", clipped(self.predict(S()))), f.weighted)
        both = zip(("before", "after"), together([lambda: metrics.guardrails(f), lambda: metrics.guardrails(after)]))
        return {"delta": self.delta, "pre_mean": self.before, "post_mean": self.after} | {f"{name}_{k}": v for name, got in both for k, v in got.items()}


def interval_to_raw(model, lo: float, hi: float, space: str = "probability", buffer_logit: float = 0.0) -> tuple[float, float]:
    """Raw interval of a calibrated one, by anything that has an ``interval_inverse``: a map, an offset, a wrapped model."""
    if not callable(getattr(model, "interval_inverse", None)):
        raise TypeError(f"{type(model).__name__} has no interval_inverse")
    return tuple(map(float, model.interval_inverse(lo, hi, space=space, buffer_logit=buffer_logit)))


def bands_to_raw(model, bands: DataFrame, space: str = "probability", buffer_logit: float = 0.0) -> DataFrame:
    """Masterscale (grade, lo, hi) on the calibrated scale with the raw interval of each grade; one row for each grade."""
    rows = [(r["grade"], r["lo"], r["hi"], *interval_to_raw(model, r["lo"], r["hi"], space, buffer_logit)) for r in bands.orderBy("lo").collect()]
    return bands.sparkSession.createDataFrame(rows, "grade string, lo double, hi double, raw_lo double, raw_hi double")


def grade_by_bands(df: DataFrame, raw_bands: DataFrame, score: str = "s") -> DataFrame:
    """Rows with their grade by raw score: an interval lookup in a masterscale, whose few rows are an array of edges."""
    rows = raw_bands.orderBy("raw_lo").collect()
    names = F.array(*[F.lit(r["grade"]) for r in rows])
    return df.withColumn("band", F.element_at(names, bin_index(F.col(score), [r["raw_lo"] for r in rows[1:]]) + 1))


def _stacked(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SCORING: dict[str, Callable[[Frame], float]] = {k: (lambda f, k=k: metrics.evaluate(f, [k])[k]) for k in ("log_loss", "brier", "ici", "smooth_ece", "ece_sweep")}


def default_menu() -> dict[str, Callable[[], Calibrator]]:
    return {"temperature": Temperature, "platt": Platt, "beta": Beta, "scaling_binning": ScalingBinning, "histogram": Histogram, "isotonic": Isotonic, "cir": CenteredIsotonic, "ivap": VennAbers}


def select(f: Frame, candidates: Mapping[str, Callable[[], Calibrator]] | None = None, scoring: str = "log_loss", cv: int = 5, seed: int = 42):
    """Nested cross-validation: the same folds for each candidate; of those within one standard error of the best, the
    simplest. Returns (report rows sorted by mean score, the winner fitted on all rows, its name)."""
    if scoring not in SCORING:
        raise ValueError(f"scoring is one of {list(SCORING)}")
    menu = candidates or default_menu()
    dealt = folds(f.df, cv, seed).persist()

    def one(make: Callable[[], Calibrator], k: int) -> tuple[float, DataFrame]:
        model = make().fit(Frame(dealt.where(F.col("fold") != k), f.weighted))
        held = dealt.where(F.col("fold") == k).withColumn("s", clipped(model.predict(S())))
        return SCORING[scoring](Frame(held, f.weighted)), held

    got = together([lambda make=make, k=k: one(make, k) for make in menu.values() for k in range(cv)])
    by_name = {name: got[i * cv : (i + 1) * cv] for i, name in enumerate(menu)}
    pooled = [_stacked([held for _, held in pairs]) for pairs in by_name.values()]
    passed = together([lambda df=df: metrics.guardrails(Frame(df, f.weighted))["all_ok"] for df in pooled])
    report = []
    for (name, pairs), ok in zip(by_name.items(), passed):
        values = [v for v, _ in pairs]
        report.append({"method": name, "mean": float(np.mean(values)), "sd": float(np.std(values, ddof=1)), "rank": menu[name]().rank, "guardrails_ok": ok})
    dealt.unpersist()
    best = min(report, key=lambda r: r["mean"])
    fair = [r for r in report if r["mean"] <= best["mean"] + best["sd"] / np.sqrt(cv)]
    chosen = min(fair, key=lambda r: (r["rank"], r["mean"]))["method"]
    for place, r in enumerate(sorted(report, key=lambda r: r["mean"]), 1):
        r["place"], r["chosen"] = place, r["method"] == chosen
    return sorted(report, key=lambda r: r["mean"]), menu[chosen]().fit(f), chosen


def out_of_fold(f: Frame, make: Callable[[], Calibrator], cv: int = 5, seed: int = 42) -> DataFrame:
    """Each row calibrated by a map that has not seen it."""
    dealt = folds(f.df, cv, seed).persist()
    models = together([lambda k=k: make().fit(Frame(dealt.where(F.col("fold") != k), f.weighted)) for k in range(cv)])
    return _stacked([dealt.where(F.col("fold") == k).withColumn("p", m.predict(S())) for k, m in enumerate(models)])


Trainer = Callable[[DataFrame], Column]


def logistic_trainer(features: Sequence[str], label: str) -> Trainer:
    """A model to calibrate: fits a logistic regression of ``label`` on numeric columns and returns its probability as a Column."""

    def train(df: DataFrame) -> Column:
        fit = irls(df, [F.lit(1.0), *[F.col(c) for c in features]], F.col(label).cast("double"), F.lit(1.0))
        return expit(sum((F.lit(b) * F.col(c) for b, c in zip(fit.beta[1:], features)), F.lit(fit.beta[0])))

    return train


class CalibratedModel:
    """A model's score, a calibrator fitted on scores of rows the model has not seen, then offsets in order.

    ``score`` is a Column over features (a probability; log-odds go through ``expit`` first) or a trainer, which fits a model
    on the rows it is given and returns such a Column; a trainer sees no weights but those it reads itself. ``flow='prefit'`` takes a
    Column and calibrates it on all rows. ``flow='cv'`` trains once for each fold on the others and scores the fold: one
    calibrator is fitted on all these scores and the model trained again on all rows, or, with ``ensemble``, each fold's model keeps a
    calibrator fitted on that fold and predictions are averaged. Every fold needs both outcomes."""

    def __init__(self, score: Column | Trainer, make: Callable[[], Calibrator], flow: str = "prefit", cv: int = 5, ensemble: bool = False, seed: int = 42):
        if flow not in ("prefit", "cv"):
            raise ValueError("flow is 'prefit' or 'cv'")
        if flow == "prefit" and not isinstance(score, Column):
            raise TypeError("flow 'prefit' takes a score column; a trainer needs flow 'cv'")
        self.score, self.make, self.flow, self.cv, self.ensemble, self.seed = score, make, flow, cv, ensemble, seed
        self.offsets: list[LogitOffset] = []

    def _train(self, df: DataFrame) -> Column:
        return self.score if isinstance(self.score, Column) else self.score(df)

    def fit(self, df: DataFrame, label: str, row_id: str, weight: str | None = None) -> CalibratedModel:
        bound = lambda rows, score: Frame.bind(rows.withColumn("_raw", score), "_raw", label, weight, row_id)
        if self.flow == "prefit":
            self.frame = bound(df, self.score)
            self.scores, self.models = [self.score], [self.make().fit(self.frame)]
            return self
        keyed = df.select(F.col(row_id).alias("row_id"), F.col(label).cast("double").alias("y"), F.struct("*").alias("_x"))
        dealt = folds(keyed, self.cv, self.seed).persist()

        def member(k: int) -> tuple[Column, Frame, Calibrator | None]:
            score = self._train(dealt.where(F.col("fold") != k).select("_x.*"))
            held = bound(dealt.where(F.col("fold") == k).select("_x.*"), score)
            return score, held, self.make().fit(held) if self.ensemble else None

        members = together([lambda k=k: member(k) for k in range(self.cv)])
        self.frame = Frame(_stacked([held.df for _, held, _ in members]), weight is not None)
        if self.ensemble:
            self.scores, self.models = [s for s, _, _ in members], [m for _, _, m in members]
        else:
            self.scores, self.models = [self._train(df)], [self.make().fit(self.frame)]
        return self

    def predict(self, score: Column | None = None) -> Column:
        parts = [m.predict(clipped(own if score is None else score)) for m, own in zip(self.models, self.scores)]
        p = sum(parts[1:], parts[0]) / len(parts)
        for o in self.offsets:
            p = o.predict(p)
        return p

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        return df.withColumn(out, self.predict())

    def offset_to(self, target_mean: float | None = None, delta: float | None = None, df: DataFrame | None = None) -> CalibratedModel:
        """Append an offset, found on the rows of ``df``, or on the scores the calibrator was fitted on."""
        if df is not None:
            now = Frame(df.select(clipped(self.predict()).alias("s"), F.lit(1.0).alias("w")))
        else:
            now = Frame(self.frame.df.withColumn("s", clipped(self.predict(S()))), self.frame.weighted)
        self.offsets.append(LogitOffset(delta, target_mean).fit(now))
        return self

    def _check(self) -> None:
        if not hasattr(self, "models"):
            raise RuntimeError("CalibratedModel has not been fitted")

    def predict_proba_2d(self, score: Column | None = None) -> Column:
        p = self.predict(score)
        return F.array(1 - p, p)

    def interval_inverse(self, lo: float, hi: float, space: str = "probability", buffer_logit: float = 0.0) -> tuple[float, float]:
        """Model scores whose final values lie in [lo, hi]: the buffer first, then the offsets, then the calibrator's inverse."""
        self._check()
        if len(self.models) > 1:
            raise NotImplementedError("an ensemble has no single inverse")
        lo, hi = buffered(lo, hi, space, buffer_logit)
        delta = sum(o.delta for o in self.offsets)
        lo, hi = (_sigma(_logit(lo) - delta) if lo > 0 else lo), (_sigma(_logit(hi) - delta) if hi < 1 else hi)
        return self.models[0].interval_inverse(lo, hi, space)

    def interpret(self, spark: SparkSession) -> DataFrame:
        """Parameters and readings of the calibrator (of each member) and of every offset, in the order of application."""
        self._check()
        return _stacked([part.interpret(spark).withColumn("stage", F.lit(k)) for k, part in enumerate([*self.models, *self.offsets])])

    @property
    def monotone(self) -> bool:
        return all(m.monotone for m in self.models)

    def affine(self) -> tuple[float, float] | None:
        if len(self.models) > 1 or (ab := self.models[0].affine()) is None:
            return None
        return ab[0], ab[1] + sum(o.delta for o in self.offsets)


def explanation(values, base_values, row_id: str = "row_id", spark: SparkSession | None = None) -> DataFrame:
    """row_id, phi, base of an explanation object's arrays (``values`` of rows by features, ``base_values`` of rows or one number)."""
    values = np.atleast_2d(np.asarray(values, float))
    base = np.broadcast_to(np.asarray(base_values, float).reshape(-1), (len(values),))
    spark = spark or SparkSession.getActiveSession()
    rows = [(i, v.tolist(), float(b)) for i, (v, b) in enumerate(zip(values, base))]
    return spark.createDataFrame(rows, f"`{row_id}` long, phi array<double>, base double")


def reconstruction_error(df: DataFrame) -> float:
    """How far adjusted attributions and base miss their target at most."""
    return df.agg(F.max(F.abs(F.col("base_adj") + F.aggregate("phi_adj", F.lit(0.0), lambda a, v: a + v) - F.col("target")))).first()[0] or 0.0


def adjust_attributions(df: DataFrame, model: Calibrator, phi: str = "phi", base: str = "base", scale: str = "logit", method: str = "auto") -> DataFrame:
    """Additive attributions moved to the calibrated scale: columns phi_adj, base_adj, target, with sum(phi_adj) + base_adj = target.

    An affine map on the log-odds scale scales them exactly; otherwise each row's are multiplied by the slope of the
    map between its base and its total (the derivative there if the two meet)."""
    if scale not in ("logit", "probability"):
        raise ValueError("scale is 'logit' or 'probability'")
    ab = model.affine() if scale == "logit" else None
    if method == "affine" and ab is None:
        raise ValueError("the map is not affine on this scale")
    b = F.col(base).cast("double")
    total = b + F.aggregate(phi, F.lit(0.0), lambda a, v: a + v)
    if ab is not None and method in ("auto", "affine"):
        factor, target = F.lit(float(ab[0])), ab[0] * total + ab[1]
    else:
        g = (lambda v: logit(model.predict(clipped(expit(v))))) if scale == "logit" else (lambda v: model.predict(clipped(v)))
        step = 1e-4
        target = g(total)
        factor = F.when(F.abs(total - b) < 1e-8, (g(b + step) - g(b - step)) / (2 * step)).otherwise((g(total) - g(b)) / F.when(F.abs(total - b) < 1e-8, 1.0).otherwise(total - b))
    out = df.withColumn("_factor", factor).withColumn("target", target).withColumn("phi_adj", F.transform(phi, lambda v: v * F.col("_factor")))
    return out.withColumn("base_adj", F.col("target") - F.aggregate("phi_adj", F.lit(0.0), lambda a, v: a + v)).drop("_factor")


def comparison(before: Frame, after: Frame, n_bins: int = 10, strategy: str = "mass", labels: Sequence[str] = ("before", "after")) -> DataFrame:
    """Plot data: reliability bins of two frames, one below the other with their panel's name."""
    return _stacked([metrics.reliability(f, n_bins, strategy).withColumn("panel", F.lit(name)) for f, name in zip((before, after), labels)])


def interval_widths(model, df: DataFrame, score: str = "s") -> DataFrame:
    """Plot data: the interval (p0, p1) of each score, its merged value and its width; ``model`` has a ``predict_interval``."""
    rows = df.withColumn("_i", model.predict_interval(clipped(F.col(score)))).select(F.col(score).alias("s"), "_i.p0", "_i.p1")
    return rows.withColumn("p", F.col("p1") / (1 - F.col("p0") + F.col("p1"))).withColumn("width", F.col("p1") - F.col("p0"))


def selection_points(spark: SparkSession, report: Sequence[Mapping], chosen: str) -> DataFrame:
    """Plot data: candidates by rank of their mean score, with the spread over folds, whether they pass the guardrails and which was chosen."""
    rows = [(k, r["method"], r["mean"], r["sd"], r["guardrails_ok"], r["method"] == chosen) for k, r in enumerate(sorted(report, key=lambda r: r["mean"]))]
    return spark.createDataFrame(rows, "place int, method string, score_mean double, score_sd double, guardrails_ok boolean, chosen boolean")


def grade_points(f: Frame, grade: str = "grade") -> DataFrame:
    """Plot data: event rate by grade with its interval, beside the grade's mean score and its light."""
    found = metrics.grade_backtest(f, grade)
    return found.select(grade, "n", "pd", (F.col("k") / F.col("n")).alias("rate"), "ci_low", "ci_high", "light")


def rug(df: DataFrame, score: str = "s", most: int = 1000, buckets: int = 256) -> DataFrame:
    """Plot data: every ceil(n / most)-th score in order, from 0. Places come from prefix sums of the counts of distinct scores."""
    n = df.count()
    stride = max(1, -(-n // most))
    per = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"))
    low, high = per.agg(F.min("s"), F.max("s")).first()
    at = F.floor((F.col("s") - F.lit(low)) / F.lit(high - low) * buckets) if n and high > low else F.lit(0)
    first = F.ceil((F.col("end") - F.col("n")) / stride) * stride
    placed = prefixed(per, at, ["s"], "end", F.col("n")).withColumn("first", first).where(F.col("first") < F.col("end"))
    return placed.select(F.explode(F.sequence(F.col("first").cast("long"), (F.col("end") - 1).cast("long"), F.lit(stride).cast("long"))).alias("place"), "s")


def ecce_band(f: Frame, width: float = 2.0) -> DataFrame:
    """Plot data: the cumulative deviation with the band of ``width`` standard deviations of a calibrated score around 0."""
    half = F.lit(width) * F.col("sd_null")
    return metrics.ecce_curve(f).select("row_id", "frac", "cumdev", (-half).alias("band_low"), half.alias("band_high"))


def reliability_points(f: Frame, n_bins: int = 10, strategy: str = "mass") -> DataFrame:
    """Plot data on the log-odds scale: the bins of the reliability curve whose event rate is neither 0 nor 1."""
    found = metrics.reliability(f, n_bins, strategy).where("event_rate > 0 and event_rate < 1")
    return found.select("bin", "count", F.col("pred_mean_logit").alias("x"), *[logit(F.col(c)).alias(to) for c, to in (("event_rate", "y"), ("ci_low", "y_low"), ("ci_high", "y_high"))])


def offset_line(spark: SparkSession, offset: LogitOffset, points: int = 200) -> DataFrame:
    """Plot data: the offset as a line on the log-odds scale, over probabilities from 0.001 to 0.5."""
    low, high = _logit(0.001), _logit(0.5)
    z = F.lit(low) + F.col("id") * F.lit((high - low) / (points - 1))
    return spark.range(points).select(F.col("id").alias("point"), z.alias("before"), (z + F.lit(float(offset.delta))).alias("after"))
