"""Metrics, tests and curves. Each is an aggregate over a Frame; results are DataFrames or small driver values."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..functions.exprs import bin_index, logit, softplus, traffic_light, wilson
from .frame import MAX_POINTS, Frame, S, TooManyPoints, W, Y, merged, prefixed
from .kernel import skce, skce_linear, skce_test  # noqa: F401
from .local_regression import Line, spread_quantiles
from .resamples import resampled
from .solvers import irls, loess, repeated_quantiles, together



def _loss():
    return -(Y() * F.log(S()) + (1 - Y()) * F.log1p(-S()))


def mean(x):
    return F.sum(W() * x) / F.sum(W())


def log_loss(f: Frame) -> DataFrame:
    return f.agg(mean(_loss()).alias("log_loss"))


def brier_score(f: Frame) -> DataFrame:
    return f.agg(mean((S() - Y()) * (S() - Y())).alias("brier"))


def brier_skill_score(f: Frame) -> DataFrame:
    return f.agg((1 - mean((S() - Y()) * (S() - Y())) / (mean(Y()) * (1 - mean(Y())))).alias("brier_skill"))


def scores(f: Frame) -> DataFrame:
    """Log loss, Brier score and skill in one pass, by the frame's ``by`` columns."""
    brier = mean((S() - Y()) * (S() - Y()))
    return f.agg(F.count("*").alias("n"), mean(_loss()).alias("log_loss"), brier.alias("brier"), (1 - brier / (mean(Y()) * (1 - mean(Y())))).alias("brier_skill"))


def bins(f: Frame, n_bins: int, strategy: str = "mass") -> DataFrame:
    """One row for each non-empty bin: count, weight, mean score, event rate."""
    where = bin_index(S(), f.edges(n_bins, strategy))
    return f.df.groupBy(where.alias("bin")).agg(F.count("*").alias("n"), F.sum("w").alias("w"), mean(S()).alias("p"), mean(Y()).alias("r"))


def murphy(f: Frame, n_bins: int = 10, strategy: str = "mass", bias_corrected: bool = False) -> DataFrame:
    base = f.df.agg(mean(Y())).first()[0]
    b = bins(f, n_bins, strategy)
    fix = F.when(F.col("n") > 1, F.col("r") * (1 - F.col("r")) / (F.col("n") - 1)).otherwise(0.0) if bias_corrected else F.lit(0.0)
    part = lambda x: F.sum(W() * (x - fix)) / F.sum(W())
    rel, res = part(F.pow(F.col("p") - F.col("r"), 2)), part(F.pow(F.col("r") - base, 2))
    if bias_corrected:
        rel, res = F.greatest(rel, F.lit(0.0)), F.greatest(res, F.lit(0.0))
    return b.agg(rel.alias("reliability"), res.alias("resolution"), F.lit(base * (1 - base)).alias("uncertainty"))


def ece(f: Frame, n_bins: int = 15, strategy: str = "mass", norm: str = "l1") -> DataFrame:
    gap = F.abs(F.col("p") - F.col("r"))
    value = {"l1": F.sum(W() * gap) / F.sum("w"), "l2": F.sqrt(F.sum(W() * gap * gap) / F.sum("w")), "max": F.max(gap)}[norm]
    return bins(f, n_bins, strategy).agg(value.alias("ece"))


def ece_debiased(f: Frame, n_bins: int = 15, strategy: str = "mass") -> DataFrame:
    gap = F.col("p") - F.col("r")
    less = F.when(F.col("n") > 1, F.sqrt(F.greatest(gap * gap - F.col("r") * (1 - F.col("r")) / (F.col("n") - 1), F.lit(0.0)))).otherwise(F.abs(gap))
    return bins(f, n_bins, strategy).agg((F.sum(W() * less) / F.sum("w")).alias("ece"))


adaptive_ece = ece


def ece_sweep(f: Frame, most: int = 100) -> DataFrame:
    """ECE at the largest number of equal-mass bins whose event rates do not fall.

    The edges of all counts of bins are found together, one aggregate sums between neighbours of them, and every
    binning adds up such cells."""
    most = min(f.df.count(), most)
    levels = sorted({k / b for b in range(2, most + 1) for k in range(1, b)})
    at = dict(zip(levels, f.quantiles(levels))) if levels else {}
    every = np.unique(list(at.values()))
    cells = f.cells(every)
    best = (abs(cells[1].sum() - cells[2].sum()) / cells[0].sum(), 1)
    for b in range(2, most + 1):
        w, ws, wy = merged(every, np.unique([at[k / b] for k in range(1, b)]), cells)
        some = w > 0
        if (np.diff(wy[some] / w[some]) >= 0).all():
            best = (float(np.abs(ws - wy).sum() / w.sum()), b)
    return f.df.sparkSession.createDataFrame([(float(best[0]), best[1])], "ece double, bins int")


def hosmer_lemeshow(f: Frame, groups: int = 10) -> dict[str, float]:
    rows = bins(f, groups).collect()
    stat = 0.0
    for r in rows:
        seen, due = r["w"] * r["r"], r["w"] * r["p"]
        stat += (seen - due) ** 2 / (due * (1 - due / r["w"]))
    df = max(len(rows) - 2, 1)
    return {"statistic": stat, "df": df, "p_value": special.chi2_sf(stat, df)}


def running(f: Frame, buckets: int = 64) -> DataFrame:
    """Walk by score then row_id with prefix sums in two steps, so no window runs over the whole table in one task.

    Adds c (cumulative w(y - p)), v (cumulative w^2 p(1 - p)), and place."""
    edges = f.edges(buckets)
    df = f.df.withColumn("bucket", bin_index(S(), edges)).withColumn("d", W() * (Y() - S())).withColumn("q", W() * W() * S() * (1 - S()))
    sums = {r["bucket"]: r for r in df.groupBy("bucket").agg(F.sum("d").alias("d"), F.sum("q").alias("q"), F.count("*").alias("n")).collect()}
    ahead, so_far = [], [0.0, 0.0, 0]
    for b in range(len(edges) + 1):
        ahead.append(tuple(so_far))
        if b in sums:
            so_far = [so_far[0] + sums[b]["d"], so_far[1] + sums[b]["q"], so_far[2] + sums[b]["n"]]
    inside = Window.partitionBy("bucket").orderBy("s", "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = [F.element_at(F.array(*[F.lit(a[k]) for a in ahead]), F.col("bucket") + 1) for k in range(3)]
    return df.select(
        "row_id", "s", "y", "w", (F.sum("d").over(inside) + start[0]).alias("c"), (F.sum("q").over(inside) + start[1]).alias("v"), (F.row_number().over(Window.partitionBy("bucket").orderBy("s", "row_id")) + start[2]).alias("place")
    )


def ecce(f: Frame) -> DataFrame:
    total = f.df.agg(F.sum("w")).first()[0]
    return running(f).agg((F.max(F.abs("c")) / total).alias("stat_max"), (F.avg(F.abs("c")) / total).alias("stat_mean"))


def ecce_curve(f: Frame) -> DataFrame:
    got = f.df.agg(F.sum("w").alias("w"), F.count("*").alias("n")).first()
    return running(f).select("row_id", (F.col("place") / F.lit(got["n"])).alias("frac"), (F.col("c") / got["w"]).alias("cumdev"), (F.sqrt("v") / got["w"]).alias("sd_null"))


def spiegelhalter(f: Frame) -> dict[str, float]:
    top = F.sum(W() * (Y() - S()) * (1 - 2 * S()))
    z = f.df.agg((top / F.sqrt(F.sum(W() * W() * F.pow(1 - 2 * S(), 2) * S() * (1 - S())))).alias("z")).first()["z"]
    if z is None:
        raise ZeroDivisionError("the statistic has no variance")
    return {"z": z, "p_value": 2 * (1 - special.norm_cdf(abs(z)))}


def _smoothed(f: Frame, frac: float = 0.75, grid: int | None = 512) -> tuple[dict, np.ndarray]:
    p = f.pooled()
    return p, loess(p["s"], p["n"], p["k"], p["s"], frac, grid=grid, weights_of=p["n"])


def ici_family(f: Frame, frac: float = 0.75, grid: int | None = 512) -> dict[str, float]:
    """Mean, median, 90th percentile and maximum distance of the local regression from the scores; the regression is
    unweighted, its average weighted."""
    try:
        p, smooth = _smoothed(f, frac, grid)
    except TooManyPoints:
        return _ici_family_far(f, frac, grid)
    apart = np.abs(smooth - p["s"])
    out = {"ici": float(np.average(apart, weights=p["w"])), "emax": float(apart.max())}
    for name, q in (("e50", 0.5), ("e90", 0.9)):
        out[name] = float(repeated_quantiles(apart, p["n"], [q])[0]) if not f.weighted else weighted_quantile(apart, q, p["w"])
    return out


def _ici_family_far(f: Frame, frac: float, grid: int | None) -> dict[str, float]:
    """The same over more distinct scores than the driver holds."""
    line = Line(f)
    fits = line.on_grid(frac, grid) if grid and line.rows > grid else line.everywhere(frac)
    apart = fits.select(F.abs(F.col("c") - S()).alias("a"), "n", "w").persist()
    ici, emax = apart.agg(F.sum(F.col("a") * W()) / F.sum("w"), F.max("a")).first()
    e50, e90 = spread_quantiles(apart, [0.5, 0.9], f.weighted)
    apart.unpersist()
    line.done()
    return {"ici": float(ici), "emax": float(emax), "e50": e50, "e90": e90}


def weighted_quantile(x: np.ndarray, q: float, w: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    x, w = x[order], w[order]
    return float(np.interp(q, (np.cumsum(w) - w / 2) / w.sum(), x))


def logloss_decomposition(f: Frame, frac: float = 0.75) -> dict[str, float]:
    try:
        p, c = _smoothed(f, frac, None)
    except TooManyPoints:
        line = Line(f)
        c = F.greatest(F.least(F.col("c"), F.lit(1 - 1e-12)), F.lit(1e-12))
        kl = c * F.log(c / S()) + (1 - c) * F.log((1 - c) / (1 - S()))
        got = line.everywhere(frac).agg(mean(kl), mean(-(c * F.log(c) + (1 - c) * F.log1p(-c)))).first()
        line.done()
        return {"calibration": float(got[0]), "refinement": float(got[1])}
    c = np.clip(c, 1e-12, 1 - 1e-12)
    kl = c * np.log(c / p["s"]) + (1 - c) * np.log((1 - c) / (1 - p["s"]))
    entropy = -(c * np.log(c) + (1 - c) * np.log1p(-c))
    return {"calibration": float(np.average(kl, weights=p["w"])), "refinement": float(np.average(entropy, weights=p["w"]))}


def _fixed_point(at: Callable[[float], float]) -> float:
    """The bandwidth that equals the error at it, by bisection; where the error at the least bandwidth is below it, that error."""
    low, high = 1e-4, 2.0
    if (value := at(low)) <= low:
        return value
    while high - low >= 1e-4:
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid) > mid else (low, mid)
    return (low + high) / 2


def _smoothed_mass(z: np.ndarray, m: np.ndarray, sigma: float) -> float:
    """Integral of the smoothed mass' absolute value on 257 points; points are dealt in blocks, so memory stays in proportion to the masses."""
    grid = np.linspace(z.min() - 5 * sigma, z.max() + 5 * sigma, 257)
    rows = max(1, (1 << 22) // len(z))
    dense = np.concatenate([np.exp(-0.5 * ((grid[k : k + rows, None] - z) / sigma) ** 2) @ m for k in range(0, 257, rows)])
    return float(np.trapezoid(np.abs(dense / (sigma * math.sqrt(2 * math.pi))), grid))


def _smoothed_lattice(m: np.ndarray, width: float, sigma: float) -> float:
    """The same for masses on a lattice: joined to about 8 cells a sigma, convolved there with the kernel, and summed. Cells apart
    by 5 sigma and more do not meet: their integral is the total variation."""
    factor = max(1, int(sigma / (8 * width)))
    if factor > 1:
        m, width = np.r_[m, np.zeros(-len(m) % factor)].reshape(-1, factor).sum(axis=1), width * factor
    if 5 * sigma <= width:
        return float(np.abs(m).sum())
    reach = math.ceil(5 * sigma / width)
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) * width / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi))
    return float(width * np.abs(np.convolve(m, taps)).sum())


def smooth_ece(f: Frame, cells: int = 8192) -> float:
    """Smooth calibration error in logit space at the bandwidth that equals it.

    Over more than ``cells`` distinct logits the residual mass is put on a lattice by one grouped sum and smoothed there; where the
    bandwidth is under 8 cells the lattice is refined once, to 2**20 cells at most. Where that does not do, and for fewer
    logits, the distinct logits are used as they are."""
    mass = f.df.groupBy(logit(S()).alias("z")).agg(F.sum(W() * (Y() - S())).alias("m"))
    total = f.df.agg(F.sum("w")).first()[0]
    lo, hi, n = mass.agg(F.min("z"), F.max("z"), F.count("*")).first()

    def solved(count: int) -> tuple[float, float]:
        width = (hi - lo) / count
        cell = F.least(F.floor((F.col("z") - lo) / width), F.lit(count - 1))
        got = mass.groupBy(cell.alias("k")).agg(F.sum("m").alias("m")).toPandas()
        m = np.bincount(got["k"].astype(int), got["m"] / total, count)
        return _fixed_point(lambda sigma: _smoothed_lattice(m, width, sigma)), width

    if n > cells and hi > lo:
        value, width = solved(cells)
        if max(value, 1e-4) >= 8 * width:
            return value
        finer = math.ceil((hi - lo) / (max(value, 1e-4) / 8))
        if finer < n and finer <= 1 << 20:
            value, width = solved(finer)
            if max(value, 1e-4) >= 8 * width:
                return value
    got = mass.orderBy("z").toPandas()
    z, m = got["z"].to_numpy(float), got["m"].to_numpy(float) / total
    return _fixed_point(lambda sigma: _smoothed_mass(z, m, sigma))


def weighted_quantiles(f: Frame, levels: Sequence[float]) -> DataFrame:
    """q, value: weighted quantiles of the scores at mid-weight positions, linear between them; ties lie in the order of row_id.

    Rows are pooled by score, so a score that many rows share is one row of the prefix sums; each level is one aggregate."""
    per = f.df.groupBy("s").agg(F.sum("w").alias("w"), F.min_by("w", "row_id").alias("head"), F.max_by("w", "row_id").alias("tail"))
    total = f.df.agg(F.sum("w")).first()[0]
    summed = prefixed(per, F.floor(S() * 256), ["s"], "end", F.col("w"))
    ends = F.array(F.col("end") - F.col("w") + F.col("head") / 2, F.col("end") - F.col("tail") / 2)
    at = summed.select("s", F.explode(ends).alias("at")).withColumn("at", F.col("at") / F.lit(total))
    points = at.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in levels])))
    place = F.struct("at", "s")
    sides = points.groupBy("q").agg(F.max(F.when(F.col("at") <= F.col("q"), place)).alias("a"), F.min(F.when(F.col("at") > F.col("q"), place)).alias("b"))
    between = F.col("a.s") + (F.col("b.s") - F.col("a.s")) * (F.col("q") - F.col("a.at")) / (F.col("b.at") - F.col("a.at"))
    return sides.select("q", F.when(F.col("a").isNull(), F.col("b.s")).when(F.col("b").isNull(), F.col("a.s")).otherwise(between).alias("value"))


def calibration_intercept(f: Frame) -> float:
    return irls(f.df, [F.lit(1.0)], Y(), W(), offset=logit(S())).beta[0]


def calibration_slope(f: Frame) -> float:
    return irls(f.df, [F.lit(1.0), logit(S())], Y(), W()).beta[1]


def calibration_test(f: Frame) -> dict[str, float]:
    """Likelihood ratio test of intercept 0 and slope 1 together."""
    fit = irls(f.df, [F.lit(1.0), logit(S())], Y(), W())
    a, b = fit.beta
    ll = lambda z: F.sum(W() * (Y() * z - softplus(z)))
    got = f.df.agg((ll(a + b * logit(S())) - ll(logit(S()))).alias("d")).first()["d"]
    stat = max(2 * got, 0.0)
    return {"statistic": stat, "p_value": special.chi2_sf(stat, 2), "alpha": a, "beta": b}


def guardrails(f: Frame) -> dict:
    slope, intercept, p = calibration_slope(f), calibration_intercept(f), spiegelhalter(f)["p_value"]
    ok = (0.9 <= slope <= 1.1, abs(intercept) <= 0.1, p > 0.05)
    return {"slope": slope, "intercept": intercept, "spiegelhalter_p": p, "slope_ok": ok[0], "intercept_ok": ok[1], "spiegelhalter_ok": ok[2], "all_ok": all(ok)}


def reliability_summary(f: Frame) -> dict:
    got = f.df.agg(F.count("*").alias("n"), F.sum("y").alias("k")).first()
    ici = ici_family(f)
    return {"n": got["n"], "events": int(got["k"]), "intercept": calibration_intercept(f), "slope": calibration_slope(f), "ici": ici["ici"], "e90": ici["e90"], "spiegelhalter_p": spiegelhalter(f)["p_value"]}


def grade_backtest(f: Frame, grade: str = "grade") -> DataFrame:
    """Per grade: count, events, mean score, exact and normal binomial p-values, Jeffreys p-value, lights and 90 % intervals.
    Weights play no part. Special functions run on the one row for each grade, in Arrow batches."""
    per = f.df.groupBy(grade).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("k"), F.avg("s").alias("pd"))

    def run(batches):
        for t in batches:
            n, k, pd_ = t["n"].to_numpy(), t["k"].to_numpy(), t["pd"].to_numpy()
            b, q = special.betainc, special.beta_ppf
            t["p_exact"] = [1.0 if e == 0 else b(e, m - e + 1, p) for m, e, p in zip(n, k, pd_)]
            t["p_normal"] = [1 - special.norm_cdf((e - m * p) / math.sqrt(m * p * (1 - p))) for m, e, p in zip(n, k, pd_)]
            t["p_jeffreys"] = [b(e + 0.5, m - e + 0.5, p) for m, e, p in zip(n, k, pd_)]
            t["ci_low"] = [0.0 if e == 0 else q(0.05, e, m - e + 1) for m, e in zip(n, k)]
            t["ci_high"] = [1.0 if e == m else q(0.95, e + 1, m - e) for m, e in zip(n, k)]
            t["jeffreys_low"] = [q(0.05, e + 0.5, m - e + 0.5) for m, e in zip(n, k)]
            t["jeffreys_high"] = [q(0.95, e + 0.5, m - e + 0.5) for m, e in zip(n, k)]
            yield t

    names = "p_exact p_normal p_jeffreys ci_low ci_high jeffreys_low jeffreys_high".split()
    kind = f.df.schema[grade].dataType.simpleString()
    out = per.mapInPandas(run, f"`{grade}` {kind}, n long, k long, pd double, " + ", ".join(f"{c} double" for c in names))
    return out.withColumn("light", traffic_light(F.col("p_exact"))).withColumn("jeffreys_light", traffic_light(F.col("p_jeffreys")))


def reliability(f: Frame, n_bins: int = 10, strategy: str = "mass") -> DataFrame:
    low, high = wilson(F.col("r"), F.col("n").cast("double"))
    return bins(f, n_bins, strategy).select("bin", F.col("p").alias("pred_mean"), F.col("r").alias("event_rate"), F.col("n").alias("count"), low.alias("ci_low"), high.alias("ci_high"), logit(F.col("p")).alias("pred_mean_logit"))


def reliability_loess(f: Frame, points: int = 100, frac: float = 0.75) -> list[tuple[float, float]]:
    try:
        p = f.pooled()
    except TooManyPoints:
        line = Line(f)
        at = np.linspace(*line.quantiles([0.005, 0.995]), points)
        fit = line.places(at, frac)
        line.done()
        return list(zip(at.tolist(), np.clip(fit, 0, 1).tolist()))
    at = np.linspace(*repeated_quantiles(p["s"], p["n"], [0.005, 0.995]), points)
    return list(zip(at.tolist(), np.clip(loess(p["s"], p["n"], p["k"], at, frac), 0, 1).tolist()))


def belt(f: Frame, confidence: Sequence[float] = (0.8, 0.95), points: int = 100, highest: int = 4) -> dict:
    """Calibration belt: polynomial in the logit by forward likelihood-ratio selection, and its bands."""
    z = logit(S())
    powers = lambda d: [F.lit(1.0), *[F.pow(z, F.lit(float(k))) for k in range(1, d + 1)]]
    fit = irls(f.df, powers(1), Y(), W())
    degree = 1
    while degree < highest and not fit.separation:
        more = irls(f.df, powers(degree + 1), Y(), W())
        if more.separation or special.chi2_sf(max(2 * (fit.loss - more.loss), 0.0), 1) >= 0.05:
            break
        fit, degree = more, degree + 1
    null = f.df.agg(F.sum(W() * (softplus(z) - Y() * z))).first()[0]
    lo, hi = f.quantiles([0.005, 0.995])
    grid = np.linspace(lo, hi, points)
    x = np.vander(np.log(grid) - np.log1p(-grid), degree + 1, increasing=True)
    eta, cov = x @ fit.beta, np.linalg.inv(fit.hessian + 1e-10 * np.eye(degree + 1))
    se2 = np.einsum("ij,jk,ik->i", x, cov, x)
    out = {"degree": degree, "p_value": special.chi2_sf(max(2 * (null - fit.loss), 0.0), degree + 1), "grid": grid}
    for c in confidence:
        half = np.sqrt(special.chi2_ppf(c, degree + 1) * se2)
        out[f"lower_{round(100 * c)}"], out[f"upper_{round(100 * c)}"] = 1 / (1 + np.exp(-(eta - half))), 1 / (1 + np.exp(-(eta + half)))
    return out


# The names of the catalogue, in its order.
CATALOGUE = (
    "log_loss", "brier", "brier_skill", "ece", "ece_debiased", "mce", "ece_sweep", "smooth_ece", "ecce_max", "ecce_mean",
    "ici", "e50", "e90", "emax", "spiegelhalter_z", "spiegelhalter_p", "intercept", "slope",
)


def _walked(f: Frame) -> dict[str, float]:
    got = ecce(f).first()
    return {"ecce_max": got["stat_max"], "ecce_mean": got["stat_mean"]}


def _standardised(f: Frame) -> dict[str, float]:
    got = spiegelhalter(f)
    return {"spiegelhalter_z": got["z"], "spiegelhalter_p": got["p_value"]}


#: What gives each metric; metrics that share a pass, a walk or a local regression share a function.
SOURCES: dict[tuple[str, ...], Callable[[Frame], dict[str, float]]] = {
    ("log_loss", "brier", "brier_skill"): lambda f: scores(f).first().asDict(),
    ("ece",): lambda f: {"ece": ece(f).first()[0]},
    ("ece_debiased",): lambda f: {"ece_debiased": ece_debiased(f).first()[0]},
    ("mce",): lambda f: {"mce": ece(f, norm="max").first()[0]},
    ("ece_sweep",): lambda f: {"ece_sweep": ece_sweep(f).first()["ece"]},
    ("smooth_ece",): lambda f: {"smooth_ece": smooth_ece(f)},
    ("ecce_max", "ecce_mean"): _walked,
    ("ici", "e50", "e90", "emax"): ici_family,
    ("spiegelhalter_z", "spiegelhalter_p"): _standardised,
    ("intercept",): lambda f: {"intercept": calibration_intercept(f)},
    ("slope",): lambda f: {"slope": calibration_slope(f)},
}


def evaluate(f: Frame, metrics: Sequence[str] | None = None) -> dict[str, float]:
    """Point values of the named metrics over the whole frame (its ``by`` columns play no part), in catalogue order."""
    unknown = set(metrics or ()) - set(CATALOGUE)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}; there are {list(CATALOGUE)}")
    asked = [c for c in CATALOGUE if metrics is None or c in metrics]
    f = Frame(f.df, f.weighted)
    got = together([lambda s=s: s(f) for names, s in SOURCES.items() if set(names) & set(asked)])
    found = {k: v for part in got for k, v in part.items()}
    return {c: found[c] for c in asked}


def _smooth_local(z: np.ndarray, m: np.ndarray) -> float:
    """``smooth_ece`` of residual masses at distinct sorted logits, the same way."""
    span = z[-1] - z[0]
    if len(z) > 8192 and span > 0:
        count = 8192
        for _ in range(2):
            width = span / count
            cell = np.minimum((z - z[0]) // width, count - 1).astype(int)
            lattice = np.bincount(cell, m, count)
            value = _fixed_point(lambda sigma: _smoothed_lattice(lattice, width, sigma))
            if max(value, 1e-4) >= 8 * width:
                return value
            count = math.ceil(span / (max(value, 1e-4) / 8))
            if count >= len(z) or count > 1 << 20:
                break
    return _fixed_point(lambda sigma: _smoothed_mass(z, m, sigma))


def _newton_local(x: np.ndarray, y: np.ndarray, w: np.ndarray, offset: np.ndarray) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    loss = lambda b: float(w @ (np.logaddexp(0, x @ b + offset) - y * (x @ b + offset)))
    now = loss(beta)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ beta + offset, -700, 700)))
        step = np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + 1e-12 * np.eye(len(beta)), x.T @ (w * (y - q)))
        while (then := loss(beta + step)) > now + 1e-12 * abs(now) and np.abs(step).max() > 1e-12:
            step = step / 2
        beta, now = beta + step, then
        if np.abs(step).max() < 1e-10 * (1 + np.abs(beta).max()):
            break
    return beta


def local_metrics(s: np.ndarray, y: np.ndarray, w: np.ndarray, weighted: bool, names: Sequence[str] = CATALOGUE) -> dict[str, float]:
    """The catalogue over arrays in the order of (s, row): what ``evaluate`` gives, for one replicate inside a task."""
    out: dict[str, float] = {}
    total, asked = w.sum(), set(names)
    avg = lambda x: float(w @ x / total)
    base = avg(y)
    out["log_loss"], out["brier"] = avg(-(y * np.log(s) + (1 - y) * np.log1p(-s))), avg((s - y) ** 2)
    out["brier_skill"] = 1 - out["brier"] / (base * (1 - base)) if 0 < base < 1 else math.nan
    sums = [np.r_[0.0, np.cumsum(x)] for x in (np.ones_like(s), w, w * s, w * y)]

    def bins_of(count: int) -> list[np.ndarray]:
        at = np.arange(1, count) / count * (len(s) - 1)
        low, high = s[np.floor(at).astype(int)], s[np.ceil(at).astype(int)]
        cut = np.r_[0, np.searchsorted(s, np.unique(low + (high - low) * (at - np.floor(at))), "left"), len(s)]
        parts = [np.diff(c[cut]) for c in sums]
        return [p[parts[0] > 0] for p in parts]

    n, ws, ps, ks = bins_of(15)
    p, r = ps / ws, ks / ws
    gap = np.abs(p - r)
    out["ece"], out["mce"] = float(ws @ gap / total), float(gap.max())
    less = np.where(n > 1, np.sqrt(np.maximum(gap * gap - r * (1 - r) / np.maximum(n - 1, 1), 0)), gap)
    out["ece_debiased"] = float(ws @ less / total)
    if "ece_sweep" in asked:
        out["ece_sweep"] = abs(avg(s) - base)
        for count in range(2, min(len(s), 100) + 1):
            n, ws, ps, ks = bins_of(count)
            if (np.diff(ks / ws) >= 0).all():
                out["ece_sweep"] = float(np.abs(ps - ks).sum() / total)
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    pooled = lambda x: np.add.reduceat(x, first)
    xs = s[first]
    if "smooth_ece" in asked:
        out["smooth_ece"] = _smooth_local(np.log(xs) - np.log1p(-xs), pooled(w * (y - s)) / total)
    walk = np.abs(sums[3][1:] - sums[2][1:])
    out["ecce_max"], out["ecce_mean"] = float(walk.max() / total), float(walk.mean() / total)
    if asked & {"ici", "e50", "e90", "emax"}:
        n, k, ws = pooled(np.ones_like(s)), pooled(y), pooled(w)
        apart = np.abs(loess(xs, n, k, xs, grid=512, weights_of=n) - xs)
        out["ici"], out["emax"] = float(ws @ apart / total), float(apart.max())
        for name, q in (("e50", 0.5), ("e90", 0.9)):
            out[name] = float(repeated_quantiles(apart, n, [q])[0]) if not weighted else weighted_quantile(apart, q, ws)
    spread = math.sqrt(float((w * w * (1 - 2 * s) ** 2 * s * (1 - s)).sum()))
    out["spiegelhalter_z"] = float((w * (y - s) * (1 - 2 * s)).sum()) / spread if spread > 0 else math.nan
    out["spiegelhalter_p"] = 2 * (1 - special.norm_cdf(abs(out["spiegelhalter_z"])))
    if asked & {"intercept", "slope"}:
        z = np.log(s) - np.log1p(-s)
        out["intercept"] = float(_newton_local(np.ones((len(s), 1)), y, w, z)[0])
        out["slope"] = float(_newton_local(np.stack([np.ones_like(z), z], axis=1), y, w, np.zeros_like(z))[1])
    return {c: out[c] for c in names}


def intervals(f: Frame, metrics: Sequence[str] | None = None, replicates: int = 1000, seed: int = 42, stratify: bool = True) -> DataFrame:
    """metric, value, ci_low, ci_high: points of ``evaluate`` and percentile intervals from resampled rows, for the whole catalogue.

    A replicate draws as many rows as there are, of each outcome by itself if ``stratify``, and each by its own seed, so results do
    not depend on partitions. Up to ``MAX_POINTS`` rows replicates are dealt over tasks; each task holds the rows once (in the order of score
    and row), counts how often each is drawn and works on the drawn ones. Larger frames are drawn range by range (``resamples``)."""
    asked = [c for c in CATALOGUE if metrics is None or c in metrics]
    points = evaluate(f, metrics)
    spark, weighted, size = f.df.sparkSession, f.weighted, f.df.count()
    if size > MAX_POINTS:
        return _between(spark, asked, points, resampled(f, size, asked, replicates, seed, stratify))
    got = f.df.orderBy("s", *(["row_id"] if "row_id" in f.df.columns else [])).select("s", "y", "w").toPandas()
    rows = spark.sparkContext.broadcast(tuple(got[c].to_numpy(float) for c in "syw"))  # MAX_POINTS rows at most

    def run(batches):
        import pandas as pd

        s, y, w = rows.value
        strata = [np.flatnonzero(y == v) for v in (0.0, 1.0)] if stratify else [np.arange(len(y))]
        for t in batches:
            found = []
            for number in t["id"]:
                rng = np.random.default_rng([seed, int(number)])
                for _ in range(100):
                    at = np.sort(np.concatenate([x[rng.integers(0, len(x), len(x))] for x in strata]))
                    if y[at].min() != y[at].max():
                        break
                else:
                    raise RuntimeError("100 resamples in a row had one outcome only; use stratify=True")
                found.append(local_metrics(s[at], y[at], w[at], weighted, asked))
            yield pd.DataFrame(found, columns=asked)

    tasks = min(replicates, 4 * max(int(spark.sparkContext.defaultParallelism), 1))
    drawn = spark.range(replicates).repartition(tasks).mapInPandas(run, ", ".join(f"`{c}` double" for c in asked)).toPandas()
    rows.unpersist()
    return _between(spark, asked, points, drawn.to_numpy(float))


def _between(spark, asked: Sequence[str], points: dict[str, float], drawn: np.ndarray) -> DataFrame:
    low, high = np.percentile(drawn, [2.5, 97.5], axis=0)
    return spark.createDataFrame([(c, float(points[c]), float(a), float(b)) for c, a, b in zip(asked, low, high)], "metric string, value double, ci_low double, ci_high double")


def bootstrap(f: Frame, replicates: int = 100, seed: int = 42) -> DataFrame:
    """Percentile intervals of log loss, Brier score and skill, Spiegelhalter's z and calibration in the large by Poisson multiplicities.

    For frames of any size: every row gets a multiplicity for each replicate from a hash of (row_id, replicate), so replicates do not depend
    on partitions; a batch of rows is multiplied with its multiplicities at once, and a task sends one row of sums for each replicate."""

    def run(batches):
        import pandas as pd

        total = np.zeros((replicates, 7))
        mix = lambda x: (lambda x: x ^ (x >> np.uint64(31)))(((x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) ^ np.uint64(seed)) * np.uint64(0x94D049BB133111EB))
        chances = np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1.0, 20.0)])
        steps = np.cumsum(chances)
        numbers = mix(np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for t in batches:
            s, y, w = (t[c].to_numpy(float) for c in "syw")
            terms = np.stack([w, w * -(y * np.log(s) + (1 - y) * np.log1p(-s)), w * (s - y) ** 2, w * y, w * s, w * (y - s) * (1 - 2 * s), w * w * (1 - 2 * s) ** 2 * s * (1 - s)], axis=1)
            key = t["h"].to_numpy(np.int64).view(np.uint64)
            for lo in range(0, len(key), 4096):
                u = (mix(key[None, lo : lo + 4096] ^ numbers[:, None]) >> np.uint64(11)) / float(1 << 53)
                total += np.searchsorted(steps, u.ravel(), "right").reshape(u.shape) @ terms[lo : lo + 4096]
        yield pd.DataFrame(total, columns=list("abcdefg")).assign(rep=np.arange(replicates))

    sent = f.df.select("s", "y", "w", F.xxhash64("row_id").alias("h")).mapInPandas(run, ", ".join(f"{c} double" for c in "abcdefg") + ", rep int")
    sums = sent.groupBy("rep").agg(*[F.sum(c).alias(c) for c in "abcdefg"])
    per = sums.select(
        (F.col("b") / F.col("a")).alias("log_loss"), (F.col("c") / F.col("a")).alias("brier"),
        (1 - (F.col("c") / F.col("a")) / ((F.col("d") / F.col("a")) * (1 - F.col("d") / F.col("a")))).alias("brier_skill"),
        (F.col("f") / F.sqrt("g")).alias("spiegelhalter_z"), ((F.col("d") - F.col("e")) / F.col("a")).alias("bias"),
    )
    ends = F.array(F.lit(0.025), F.lit(0.975))
    return per.agg(*[F.percentile(c, ends)[k].alias(f"{c}_{side}") for c in ("log_loss", "brier", "brier_skill", "spiegelhalter_z", "bias") for k, side in enumerate(("low", "high"))])


