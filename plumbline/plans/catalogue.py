"""The named queries of the calibration engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import logit
from ..operators import calibrators as C
from ..operators import metrics as M
from ..operators import stages as T
from ..operators.frame import Frame
from ..session import ship
from ..sources.tables import orders_frame, portfolio
from ..streaming.windows import windowed_scores
from .sql import HULL, LOGIT, PLATT, binned, frame, newton

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _cal(spark: SparkSession, sf_dir: str, weight: str | None = "w", digits: int | None = None, by=()) -> Frame:
    ship(spark)
    df = orders_frame(spark, sf_dir, digits)
    return Frame(Frame.bind(df, weight=weight, by=("grade",), strict=False).df, weight is not None, tuple(by))


def _whole(f: Frame) -> Frame:
    return Frame(f.df, f.weighted)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else (F.col(c).cast("long").alias(c) if t == "int" else F.col(c)) for c, t in df.dtypes])


def _row(spark: SparkSession, values: dict) -> DataFrame:
    values = {k: (v if isinstance(v, (bool, str)) else int(v) if isinstance(v, int) else float(v)) for k, v in values.items()}
    kinds = {bool: "boolean", str: "string", int: "long", float: "double"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


def query(name: str, sql: str | None = None, digits: int = 6, **options):
    """Register a query; its function gets (frame, spark, sf_dir) and returns a DataFrame, or a dict for one row."""

    def put(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(_cal(spark, sf_dir, **options), spark, sf_dir)
            return _rounded(_row(spark, out) if isinstance(out, dict) else out, digits)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn

    return put


def _r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits})"


_ONE = {"weight": None}
_LL, _BS = "sum(w*-(y*ln(s)+(1-y)*ln(1-s)))/sum(w)", "sum(w*(s-y)*(s-y))/sum(w)"
_UNC = "((sum(w*y)/sum(w))*(1-sum(w*y)/sum(w)))"

query("log_loss", f"WITH {frame()} SELECT {_r(_LL.replace('w*', '').replace('sum(w)', 'count(*)'))} AS log_loss FROM cal", **_ONE)(lambda f, *_: M.log_loss(f))
query("brier", f"WITH {frame()} SELECT round(avg((s-y)*(s-y)), 6) AS brier FROM cal", **_ONE)(lambda f, *_: M.brier_score(f))
query("brier_skill", f"WITH {frame()} SELECT round(1 - avg((s-y)*(s-y))/(avg(y)*(1-avg(y))), 6) AS brier_skill FROM cal", **_ONE)(lambda f, *_: M.brier_skill_score(f))
_SCORES = f"count(*) AS n, {_r(_LL)} AS log_loss, {_r(_BS)} AS brier, round(1-{_BS}/{_UNC}, 6) AS brier_skill"
query("scores_weighted", f"WITH {frame()} SELECT {_SCORES} FROM cal")(lambda f, *_: M.scores(f))
query("scores_by_grade", f"WITH {frame()} SELECT grade, {_SCORES} FROM cal GROUP BY grade", by=("grade",))(lambda f, *_: M.scores(f))
_MURPHY = "(SELECT sum(w*y)/sum(w) AS m FROM cal)"
query("murphy", f"WITH {frame()}, {binned(10, w='w')} SELECT round(sum(w*(p-r)*(p-r))/sum(w), 6) AS reliability, round(sum(w*(r-m)*(r-m))/sum(w), 6) AS resolution, round(max(m*(1-m)), 6) AS uncertainty FROM b, {_MURPHY}")(lambda f, *_: M.murphy(f))
_FIX = "(CASE WHEN n > 1 THEN r*(1-r)/(n-1) ELSE 0 END)"
query("murphy_bias_corrected", f"WITH {frame()}, {binned(10, w='w')} SELECT round(greatest(sum(w*((p-r)*(p-r)-{_FIX}))/sum(w), 0), 6) AS reliability, round(greatest(sum(w*((r-m)*(r-m)-{_FIX}))/sum(w), 0), 6) AS resolution, round(max(m*(1-m)), 6) AS uncertainty FROM b, {_MURPHY}")(lambda f, *_: M.murphy(f, bias_corrected=True))

_GAP = "sum(w*abs(p-r))/sum(w)"
query("ece_mass", f"WITH {frame()}, {binned(15, w='w')} SELECT {_r(_GAP)} AS ece FROM b")(lambda f, *_: M.ece(f))
query("adaptive_ece", f"WITH {frame()}, {binned(15)} SELECT {_r(_GAP)} AS ece FROM b", **_ONE)(lambda f, *_: M.adaptive_ece(f))
query("ece_width", f"WITH {frame()}, {binned(15, 'width', w='w')} SELECT {_r(_GAP)} AS ece FROM b")(lambda f, *_: M.ece(f, strategy="width"))
query("ece_l2", f"WITH {frame()}, {binned(15, w='w')} SELECT round(sqrt(sum(w*(p-r)*(p-r))/sum(w)), 6) AS ece FROM b")(lambda f, *_: M.ece(f, norm="l2"))
query("mce", f"WITH {frame()}, {binned(15, w='w')} SELECT round(max(abs(p-r)), 6) AS ece FROM b")(lambda f, *_: M.ece(f, norm="max"))
query("ece_debiased", f"WITH {frame()}, {binned(15, w='w')} SELECT round(sum(w*CASE WHEN n > 1 THEN sqrt(greatest((p-r)*(p-r)-r*(1-r)/(n-1), 0)) ELSE abs(p-r) END)/sum(w), 6) AS ece FROM b")(lambda f, *_: M.ece_debiased(f))
_SWEEP = " UNION ALL ".join(f"SELECT {n} AS nb, list_sort(list_distinct(quantile_cont(s, [{', '.join(f'{k / n!r}::DOUBLE' for k in range(1, n))}]))) AS e FROM cal" for n in range(2, 101))
query("ece_sweep", f"""WITH {frame()}, e AS MATERIALIZED ({_SWEEP}), g AS MATERIALIZED (SELECT s, sum(w) AS w, sum(w*s) AS ws, sum(w*y) AS wy FROM cal GROUP BY s),
r AS (SELECT nb, len(list_filter(e, lambda v: v <= s)) AS bin, sum(w) AS w, sum(ws) AS ws, sum(wy) AS wy FROM g, e GROUP BY nb, bin),
f AS (SELECT *, wy/w < lag(wy/w) OVER (PARTITION BY nb ORDER BY bin) AS fall FROM r),
ok AS (SELECT nb, sum(abs(ws-wy))/sum(w) AS ece FROM f GROUP BY nb HAVING NOT max(coalesce(fall, false))
  UNION ALL SELECT 1, abs(sum(w*s)/sum(w)-sum(w*y)/sum(w)) FROM cal)
SELECT round(arg_max(ece, nb), 6) AS ece, CAST(max(nb) AS BIGINT) AS bins FROM ok""", digits=6)(lambda f, s, d: M.ece_sweep(f))
_HL = "sum(power(w*r-w*p, 2)/(w*p*(1-p)))"
query("hosmer_lemeshow", f"WITH {frame()}, {binned(10)}, h AS (SELECT {_HL} AS x, count(*) AS m FROM b) SELECT round(x, 6) AS statistic, CAST(greatest(m-2, 1) AS BIGINT) AS df, round(exp(-x/2)*(1+x/2+x*x/8+x*x*x/48), 6) AS p_value FROM h", **_ONE)(lambda f, *_: M.hosmer_lemeshow(f))

_WALK = f"WITH {frame()}, t AS (SELECT *, sum(w*(y-s)) OVER o / sum(w) OVER () AS c, sqrt(sum(w*w*s*(1-s)) OVER o) / sum(w) OVER () AS sd, row_number() OVER (ORDER BY s, row_id) / CAST(count(*) OVER () AS DOUBLE) AS frac FROM cal WINDOW o AS (ORDER BY s, row_id ROWS UNBOUNDED PRECEDING))"
query("ecce", f"{_WALK} SELECT round(max(abs(c)), 6) AS stat_max, round(avg(abs(c)), 6) AS stat_mean FROM t")(lambda f, *_: M.ecce(f))
query("ecce_curve", f"{_WALK} SELECT row_id, round(frac, 6) AS frac, round(c, 6) AS cumdev, round(sd, 6) AS sd_null FROM t")(lambda f, *_: M.ecce_curve(f))
_SZ = "sum(w*(y-s)*(1-2*s))/sqrt(sum(w*w*power(1-2*s, 2)*s*(1-s)))"


def _two_sided(z: str) -> str:
    """Both tails of the normal distribution beyond z, by the midpoint rule."""
    return f"(SELECT 2*sum(exp(-power(abs({z})+(k+0.5)*0.0005, 2)/2))*0.0005/sqrt(2*pi()) FROM range(24000) u(k))"


query("spiegelhalter_p", f"WITH {frame()}, sz AS MATERIALIZED (SELECT {_SZ} AS z FROM cal) SELECT round({_two_sided('z')}, 6) AS p_value FROM sz")(lambda f, *_: {"p_value": M.spiegelhalter(f)["p_value"]})
query("spiegelhalter", f"WITH {frame()} SELECT round(sum(w*(y-s)*(1-2*s))/sqrt(sum(w*w*power(1-2*s, 2)*s*(1-s))), 6) AS z FROM cal")(lambda f, *_: {"z": M.spiegelhalter(f)["z"]})
_LOESS = f"""WITH {frame()},
o AS MATERIALIZED (SELECT s, row_number() OVER (ORDER BY s, row_id) - 1 AS i FROM cal), k AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(ceil(0.75*count(*)) AS BIGINT) AS r FROM cal),
win AS MATERIALIZED (SELECT a.i, a.s AS lo, b.s AS hi, c.s AS nxt FROM k, o a JOIN o b ON b.i = a.i + k.r - 1 LEFT JOIN o c ON c.i = a.i + k.r),
g AS MATERIALIZED (SELECT s, CAST(count(*) AS DOUBLE) AS n, sum(y) AS y FROM cal GROUP BY s),
st AS MATERIALIZED (SELECT g.s AS x0, min(i) AS i FROM g, win WHERE nxt IS NULL OR nxt - g.s >= g.s - lo GROUP BY g.s),
h AS MATERIALIZED (SELECT x0, greatest(x0-lo, hi-x0) AS h FROM st JOIN win USING (i)),
t AS (SELECT x0, g.n, g.y, g.s - x0 AS d, power(1-power(abs(g.s-x0)/h, 3), 3) AS k FROM h JOIN g ON abs(g.s-x0) < h),
m AS MATERIALIZED (SELECT x0, sum(k*n) AS s0, sum(k*n*d) AS s1, sum(k*n*d*d) AS s2, sum(k*y) AS sy, sum(k*y*d) AS sxy FROM t GROUP BY x0),
fit AS MATERIALIZED (SELECT x0 AS s, (s2*sy-s1*sxy)/(s0*s2-s1*s1) AS c FROM m)"""
query("ici_family", f"{_LOESS} SELECT round(sum(w*abs(c-s))/sum(w), 6) AS ici, round(max(abs(c-s)), 6) AS emax FROM cal JOIN fit USING (s)", digits=6)(lambda f, s, d: {k: v for k, v in M.ici_family(f, grid=None).items() if k in ("ici", "emax")})
query("logloss_decomposition", f"{_LOESS} SELECT round(sum(w*(c*ln(c/s)+(1-c)*ln((1-c)/(1-s))))/sum(w), 6) AS calibration, round(sum(w*-(c*ln(c)+(1-c)*ln(1-c)))/sum(w), 6) AS refinement FROM cal JOIN fit USING (s)")(lambda f, s, d: M.logloss_decomposition(f))
_ANCHORS = ", ".join(f"{k / 511!r}::DOUBLE" for k in range(512))


def _anchored(anchors: str) -> str:
    """The local regression at given places instead of at every score."""
    return _LOESS.replace(f"WITH {frame()}", f"{frame()}, anchors AS MATERIALIZED ({anchors})").replace(
        "SELECT g.s AS x0, min(i) AS i FROM g, win WHERE nxt IS NULL OR nxt - g.s >= g.s - lo GROUP BY g.s", "SELECT x0, min(i) AS i FROM anchors, win WHERE nxt IS NULL OR nxt - x0 >= x0 - lo GROUP BY x0"
    )


#: Distances of the interpolated local regression from each distinct score, with their weights, and weighted quantiles of these.
_APART = f"""{_anchored(f"SELECT unnest(list_distinct(quantile_cont(s, [{_ANCHORS}]))) AS x0 FROM cal")},
seg AS MATERIALIZED (SELECT s AS x0, c, lead(s) OVER (ORDER BY s) AS x1, lead(c) OVER (ORDER BY s) AS c1 FROM fit),
wd AS MATERIALIZED (SELECT s, sum(w) AS w FROM cal GROUP BY s),
ap AS MATERIALIZED (SELECT wd.s, wd.w, abs(coalesce(c + (c1-c)*(wd.s-x0)/(x1-x0), c) - wd.s) AS d FROM wd JOIN seg ON wd.s >= x0 AND (wd.s < x1 OR x1 IS NULL)),
aq AS MATERIALIZED (SELECT d, (sum(w) OVER (ORDER BY d, s ROWS UNBOUNDED PRECEDING) - w/2) / sum(w) OVER () AS q FROM ap)"""


def _at(q: float) -> str:
    low, high = f"(SELECT {{}}(d, q) FROM aq WHERE q <= {q})".format("max_by"), f"(SELECT {{}}(d, q) FROM aq WHERE q > {q})".format("min_by")
    return f"{low} + ({high}-{low}) * ({q}-(SELECT max(q) FROM aq WHERE q <= {q})) / ((SELECT min(q) FROM aq WHERE q > {q})-(SELECT max(q) FROM aq WHERE q <= {q}))"


query("ici_quantiles", f"WITH {_APART} SELECT round({_at(0.5)}, 6) AS e50, round({_at(0.9)}, 6) AS e90")(lambda f, *_: {k: v for k, v in M.ici_family(f).items() if k in ("e50", "e90")})
query("smooth_ece", f"""WITH RECURSIVE {frame()}, zm AS MATERIALIZED (SELECT {LOGIT} AS z, sum(w*(y-s))/any_value(t) AS m FROM cal, (SELECT sum(w) AS t FROM cal) GROUP BY 1), rg AS MATERIALIZED (SELECT min(z) AS a, max(z) AS b FROM zm),
bi(lo, hi, k) AS (SELECT 1e-4::DOUBLE, 2.0::DOUBLE, 0 UNION ALL
  SELECT CASE WHEN v > mid THEN mid ELSE lo END, CASE WHEN v > mid THEN hi ELSE mid END, k+1 FROM (SELECT lo, hi, k, mid, sum(abs(d)*CASE WHEN j IN (0, 256) THEN 0.5 ELSE 1 END)*step AS v FROM (
    SELECT lo, hi, k, mid, j, step, sum(m*exp(-0.5*power((a-5*mid+j*step-z)/mid, 2)))/(mid*sqrt(2*pi())) AS d
    FROM (SELECT *, (b-a+10*mid)/256 AS step FROM (SELECT *, (lo+hi)/2 AS mid FROM bi, rg WHERE hi-lo >= 1e-4)), range(257) t(j), zm GROUP BY lo, hi, k, mid, a, j, step) GROUP BY lo, hi, k, mid, step))
SELECT round((lo+hi)/2, 6) AS smooth_ece FROM bi ORDER BY k DESC LIMIT 1""")(lambda f, *_: {"smooth_ece": M.smooth_ece(f)})
_PAIR = "2*exp(-abs(a.s-b.s)/0.1::DOUBLE)*(a.y-a.s)*(b.y-b.s)"
query("skce_uq", f"WITH {frame()} SELECT round(avg({_PAIR}), 6) AS skce FROM cal a JOIN cal b ON a.row_id <> b.row_id", **_ONE)(lambda f, *_: {"skce": M.skce(f, 0.1)})
query("skce_biased", f"WITH {frame()} SELECT round(avg({_PAIR}), 6) AS skce FROM cal a, cal b", **_ONE)(lambda f, *_: {"skce": M.skce(f, 0.1, biased=True)})
_SHUFFLED = f"{frame()}, o AS (SELECT s, y - s AS r, row_number() OVER (ORDER BY md5(row_id || ':42'), row_id) - 1 AS i FROM cal)"
query("skce_ul", f"""WITH {_SHUFFLED}, t AS (SELECT 2*exp(-abs(a.s-b.s)/0.1::DOUBLE)*a.r*b.r AS term FROM o a JOIN o b ON b.i = a.i + 1 WHERE a.i % 2 = 0)
SELECT count(*) AS pairs, round(avg(term), 6) AS skce, round(stddev_samp(term), 6) AS sd FROM t""")(lambda f, *_: M.skce_linear(_whole(f), 0.1))
query("skce_test_asymptotic", None)(lambda f, *_: M.skce_test(_whole(f), "asymptotic"))
query("skce_test_bootstrap", None)(lambda f, *_: M.skce_test(_whole(f), replicates=199))

_INT = newton(["1.0"], offset=LOGIT, name="ni")
_SLO = newton(["1.0", LOGIT], name="ns")
query("cal_intercept", f"WITH {frame()}, {_INT} SELECT round(b0, 6) AS intercept FROM ni")(lambda f, *_: {"intercept": M.calibration_intercept(f)})
query("cal_slope", f"WITH {frame()}, {_SLO} SELECT round(b1, 6) AS slope FROM ns")(lambda f, *_: {"slope": M.calibration_slope(f)})
query("cal_test", f"""WITH {frame()}, {_SLO}, ll AS (SELECT 2*(sum(w*(y*(b0+b1*{LOGIT}) - ln(1+exp(b0+b1*{LOGIT})))) - sum(w*(y*{LOGIT} - ln(1+exp({LOGIT}))))) AS x FROM cal, ns)
SELECT round(x, 4) AS statistic, round(exp(-x/2), 4) AS p_value, round(b0, 4) AS alpha, round(b1, 4) AS beta FROM ll, ns""", digits=4)(lambda f, *_: M.calibration_test(f))
query("guardrails", f"""WITH {frame()}, {_SLO}, {_INT}, z AS (SELECT abs(sum(w*(y-s)*(1-2*s))/sqrt(sum(w*w*power(1-2*s, 2)*s*(1-s)))) AS z FROM cal)
SELECT round(ns.b1, 6) AS slope, round(ni.b0, 6) AS intercept, ns.b1 BETWEEN 0.9 AND 1.1 AS slope_ok, abs(ni.b0) <= 0.1 AS intercept_ok, z < 1.959964 AS spiegelhalter_ok,
  (ns.b1 BETWEEN 0.9 AND 1.1) AND abs(ni.b0) <= 0.1 AND z < 1.959964 AS all_ok FROM ns, ni, z""")(lambda f, *_: {k: v for k, v in M.guardrails(f).items() if k != "spiegelhalter_p"})
query("reliability_summary", f"""WITH {_APART}, {_SLO}, {_INT}, sz AS MATERIALIZED (SELECT {_SZ} AS z FROM cal), su AS MATERIALIZED (SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS events FROM cal)
SELECT n, events, round(ni.b0, 6) AS intercept, round(ns.b1, 6) AS slope, round((SELECT sum(w*d)/sum(w) FROM ap), 6) AS ici, round({_at(0.9)}, 6) AS e90, round({_two_sided('z')}, 6) AS spiegelhalter_p FROM su, ni, ns, sz""")(lambda f, *_: M.reliability_summary(f))
#: Each value of the catalogue from the query that has it.
_VALUES = {
    "log_loss": ("scores_weighted", "log_loss"), "brier": ("scores_weighted", "brier"), "brier_skill": ("scores_weighted", "brier_skill"), "ece": ("ece_mass", "ece"), "ece_debiased": ("ece_debiased", "ece"),
    "mce": ("mce", "ece"), "ece_sweep": ("ece_sweep", "ece"), "smooth_ece": ("smooth_ece", "smooth_ece"), "ecce_max": ("ecce", "stat_max"), "ecce_mean": ("ecce", "stat_mean"), "ici": ("reliability_summary", "ici"),
    "e50": ("ici_quantiles", "e50"), "e90": ("ici_quantiles", "e90"), "spiegelhalter_z": ("spiegelhalter", "z"), "spiegelhalter_p": ("spiegelhalter_p", "p_value"), "intercept": ("cal_intercept", "intercept"), "slope": ("cal_slope", "slope"),
}
_EMAX = f"(SELECT emax FROM (WITH {_APART} SELECT round(max(d), 6) AS emax FROM ap)) AS emax"
query("evaluate_points", "SELECT " + ", ".join(f"(SELECT {c} FROM ({_SQL[q]})) AS {name}" for name, (q, c) in _VALUES.items()) + f", {_EMAX}")(lambda f, *_: M.evaluate(f))
query("bootstrap_ci", None)(lambda f, *_: M.bootstrap(f, 1000))
query("evaluate_intervals", None)(lambda f, *_: M.intervals(f, replicates=100))

_GRADE = f"WITH {frame()}, g AS MATERIALIZED (SELECT grade, count(*) AS n, CAST(sum(y) AS BIGINT) AS k, avg(s) AS pd FROM cal GROUP BY grade)"
query("binomial_grade", f"""{_GRADE}, t AS (SELECT grade, sum(exp(lgamma(n+1)-lgamma(j+1)-lgamma(n-j+1)+j*ln(pd)+(n-j)*ln(1-pd))) AS p FROM (SELECT *, unnest(range(k, n+1)) AS j FROM g) GROUP BY grade)
SELECT grade, n, k, round(pd, 6) AS pd, round(p, 6) AS p_exact, CASE WHEN p <= 0.01 THEN 'red' WHEN p <= 0.05 THEN 'amber' ELSE 'green' END AS light FROM g JOIN t USING (grade)""")(lambda f, *_: M.grade_backtest(f).select("grade", "n", "k", "pd", "p_exact", "light"))
query("jeffreys_grade", f"""{_GRADE}, t AS (SELECT grade, avg(exp(lgamma(n+1)-lgamma(k+0.5)-lgamma(n-k+0.5)+(k-0.5)*ln(x)+(n-k-0.5)*ln(1-x)))*any_value(pd) AS p
  FROM (SELECT *, pd*(unnest(range(0, 20000))+0.5)/20000 AS x FROM g) GROUP BY grade)
SELECT grade, n, k, round(p, 4) AS p_jeffreys FROM g JOIN t USING (grade)""", digits=4)(lambda f, *_: M.grade_backtest(f).select("grade", "n", "k", "p_jeffreys"))
_WIL = "(r+3.841458820694124/(2*n))/(1+3.841458820694124/n)"
_HALF = "1.959963984540054*sqrt(r*(1-r)/n+3.841458820694124/(4.0*n*n))/(1+3.841458820694124/n)"
_REL = f"SELECT CAST(bin AS BIGINT) AS bin, round(p, 6) AS pred_mean, round(r, 6) AS event_rate, n AS count, round(least(greatest({_WIL}-{_HALF}, 0), r), 6) AS ci_low, round(greatest(least({_WIL}+{_HALF}, 1), r), 6) AS ci_high, round(ln(p)-ln(1-p), 6) AS pred_mean_logit FROM b"
query("reliability_mass", f"WITH {frame()}, {binned(10, w='w')} {_REL}")(lambda f, *_: M.reliability(f))
query("reliability_width", f"WITH {frame()}, {binned(10, 'width', w='w')} {_REL}")(lambda f, *_: M.reliability(f, strategy="width"))
_CURVE = _anchored("SELECT DISTINCT lo + (hi-lo)*k/99.0::DOUBLE AS x0 FROM (SELECT quantile_cont(s, 0.005::DOUBLE) AS lo, quantile_cont(s, 0.995::DOUBLE) AS hi FROM cal), range(100) u(k)")
query("reliability_loess", f"WITH {_CURVE} SELECT round(s, 6) AS grid_p, round(least(greatest(c, 0), 1), 6) AS event_rate FROM fit")(lambda f, s, d: s.createDataFrame(M.reliability_loess(f), "grid_p double, event_rate double"))


@query("belt", None)
def _belt(f, spark, d):
    b = M.belt(f)
    return spark.createDataFrame([(float(g), float(l80), float(u80), float(l95), float(u95), b["degree"], b["p_value"]) for g, l80, u80, l95, u95 in zip(b["grid"], b["lower_80"], b["upper_80"], b["lower_95"], b["upper_95"])], "grid_p double, lower_80 double, upper_80 double, lower_95 double, upper_95 double, degree long, p_value double")


def _predict(model: C.Calibrator, f: Frame) -> DataFrame:
    return model.fit(f).transform(f.df).select("row_id", "p")


def _sig(z: str) -> str:
    return f"1/(1+exp(-({z})))"


query("platt", f"WITH {frame()}, {PLATT} SELECT row_id, round({_sig('b0+b1*' + LOGIT)}, 6) AS p FROM cal, pl")(lambda f, *_: _predict(C.Platt(), f))
_TEMP = newton([LOGIT], name="nt")
query("temperature", f"WITH {frame()}, {_TEMP} SELECT row_id, round({_sig('b0*' + LOGIT)}, 6) AS p FROM cal, nt")(lambda f, *_: _predict(C.Temperature(), f))
query("beta_a", f"WITH {frame()}, {_TEMP} SELECT row_id, round({_sig('b0*' + LOGIT)}, 6) AS p FROM cal, nt")(lambda f, *_: _predict(C.Beta("a"), f))
query("beta_ab", f"WITH {frame()}, {_SLO} SELECT row_id, round({_sig('b0+b1*' + LOGIT)}, 6) AS p FROM cal, ns")(lambda f, *_: _predict(C.Beta("ab"), f))
query("beta_abm", f"WITH {frame()}, {newton(['1.0', 'ln(s)', '-ln(1-s)'], name='n3')} SELECT row_id, round({_sig('b0+b1*ln(s)-b2*ln(1-s)')}, 5) AS p FROM cal, n3", digits=5)(lambda f, *_: _predict(C.Beta(), f))
query("histogram_mass", f"WITH {frame()}, {binned(10, w='w')} SELECT row_id, round((k+0.5)/(b.w+1), 6) AS p FROM b_r JOIN b USING (bin)")(lambda f, *_: _predict(C.Histogram(), f))
query("histogram_width", f"WITH {frame()}, {binned(10, 'width', w='w')} SELECT row_id, round((k+0.5)/(b.w+1), 6) AS p FROM b_r JOIN b USING (bin)")(lambda f, *_: _predict(C.Histogram(strategy="width"), f))
query("scaling_binning", f"WITH {frame()}, {PLATT}, pg AS MATERIALIZED (SELECT cal.*, {_sig('b0+b1*' + LOGIT)} AS g FROM cal, pl), {binned(10, w='w', x='g', source='pg')} SELECT row_id, round(b.p, 5) AS p FROM b_r JOIN b USING (bin)", digits=5)(lambda f, *_: _predict(C.ScalingBinning(), f))
_MODELS = " UNION ALL ".join(f"SELECT {n} AS nb, list_sort(list_distinct(quantile_cont(s, [{', '.join(f'{k / n!r}::DOUBLE' for k in range(1, n))}]))) AS e FROM cal" for n in range(2, 51))
query("bbq", f"""WITH {frame()}, e AS MATERIALIZED ({_MODELS}), g AS MATERIALIZED (SELECT s, sum(w) AS w, sum(w*y) AS k FROM cal GROUP BY s),
a AS MATERIALIZED (SELECT nb, s, w, k, len(list_filter(e, lambda v: v <= s)) AS bin FROM g, e),
r AS MATERIALIZED (SELECT nb, bin, sum(w) AS n, sum(k) AS k FROM a GROUP BY nb, bin),
l AS MATERIALIZED (SELECT nb, sum(lgamma(k+0.5)+lgamma(n-k+0.5)-lgamma(n+1)-2*lgamma(0.5)) AS l FROM r GROUP BY nb),
v AS MATERIALIZED (SELECT nb, exp(l-max(l) OVER ()) / sum(exp(l-m)) OVER () AS v FROM (SELECT *, max(l) OVER () AS m FROM l)),
f AS MATERIALIZED (SELECT s, sum(v*(r.k+0.5)/(r.n+1)) AS p FROM a JOIN r USING (nb, bin) JOIN v USING (nb) GROUP BY s)
SELECT row_id, round(p, 6) AS p FROM cal JOIN f USING (s)""")(lambda f, s, d: _predict(C.BBQ(max_bins=50), f))
_ISO = f"WITH RECURSIVE {frame()}, {HULL}"
query("isotonic", f"{_ISO} SELECT row_id, round(fit, 6) AS p FROM cal JOIN g USING (s) JOIN iso USING (i)")(lambda f, s, d: _predict(C.Isotonic(), f))


def _line(x: str) -> str:
    return f"""{_ISO}, kn AS MATERIALIZED (SELECT {x} AS x, fit, lead({x}) OVER (ORDER BY first) AS x1, lead(fit) OVER (ORDER BY first) AS f1 FROM blocks), en AS (SELECT min(x) AS a, max(x) AS b, min(fit) AS fa, max(fit) AS fb FROM kn)
SELECT row_id, round(CASE WHEN s <= a THEN fa WHEN s >= b THEN fb ELSE (SELECT fit + (f1-fit)*(s-x)/(x1-x) FROM kn WHERE x <= s AND s < x1) END, 6) AS p FROM cal, en"""


query("isotonic_linear", _line("(first+last)/2"))(lambda f, s, d: _predict(C.Isotonic("linear"), f))
query("cir", _line("centre"))(lambda f, s, d: _predict(C.CenteredIsotonic(), f))
query("ivap", None)(
    lambda f, *_: (lambda m: m.transform(f.df).withColumn("i", m.predict_interval(F.col("s"))).select("row_id", "i.p0", "i.p1", "p"))(C.VennAbers().fit(f))
)
query("cvap", None)(lambda f, *_: _predict(C.CrossVennAbers(), f))
query("enir", None, digits=6)(lambda f, *_: _predict(C.ENIR(), f))
query("spline", None)(lambda f, *_: _predict(C.Spline(), f))
query("reliability_spline", None)(lambda f, s, d: _predict(C.Spline(), f).join(f.df.select("row_id", "s"), "row_id").groupBy(F.round("s", 2).alias("grid_p")).agg(F.avg("p").alias("event_rate")))

_BANDS = [("A", 0.0, 0.2), ("B", 0.2, 0.3), ("C", 0.3, 0.4), ("D", 0.4, 1.0)]


def _bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_BANDS, "grade string, lo double, hi double")


_BAND_SQL = f"""WITH {frame()}, {PLATT}, bands(grade, lo, hi) AS (VALUES {', '.join(f"('{g}', {a}::DOUBLE, {b}::DOUBLE)" for g, a, b in _BANDS)}),
raw AS MATERIALIZED (SELECT grade, lo, hi, CASE WHEN lo <= 0 THEN 0 ELSE 1/(1+exp(-((ln(lo)-ln(1-lo)-b0)/b1))) END AS raw_lo, CASE WHEN hi >= 1 THEN 1 ELSE 1/(1+exp(-((ln(hi)-ln(1-hi)-b0)/b1))) END AS raw_hi FROM bands, pl)"""
query("masterscale_bands", f"{_BAND_SQL} SELECT grade, lo, hi, round(raw_lo, 6) AS raw_lo, round(raw_hi, 6) AS raw_hi FROM raw")(lambda f, s, d: T.bands_to_raw(C.Platt().fit(f), _bands(s)))
query("grade_portfolio_by_band", f"{_BAND_SQL} SELECT raw.grade AS band, count(*) AS n, round(avg(y), 6) AS rate FROM cal JOIN raw ON s >= raw_lo AND (s < raw_hi OR raw_hi = 1) GROUP BY raw.grade")(
    lambda f, s, d: T.grade_by_bands(f.df, T.bands_to_raw(C.Platt().fit(f), _bands(s))).groupBy("band").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
)
query("platt_interval_inverse", f"WITH {frame()}, {PLATT} SELECT round({_sig('(ln(0.2)-ln(0.8)-b0)/b1')}, 6) AS raw_lo, round({_sig('(ln(0.4)-ln(0.6)-b0)/b1')}, 6) AS raw_hi FROM pl")(
    lambda f, *_: dict(zip(("raw_lo", "raw_hi"), C.Platt().fit(f).interval_inverse(0.2, 0.4)))
)
query("isotonic_interval_inverse", f"{_ISO} SELECT round((SELECT min(s) FROM iso JOIN g USING (i) WHERE fit >= 0.2 - 1e-12), 6) AS raw_lo, round((SELECT min(s) FROM iso JOIN g USING (i) WHERE fit > 0.3 + 1e-12), 6) AS raw_hi")(
    lambda f, s, d: dict(zip(("raw_lo", "raw_hi"), C.Isotonic().fit(f).interval_inverse(0.2, 0.3)))
)
_BETA = newton(["1.0", "ln(s)", "-ln(1-s)"], name="n3")
_ETA = lambda z: f"(b0 - b1*ln(1+exp(-({z}))) + b2*ln(1+exp({z})))"
query("beta_point_inverse", f"""WITH RECURSIVE {frame()}, {_BETA}, bi(p, lo, hi, k) AS (
  SELECT p, -40.0::DOUBLE, 40.0::DOUBLE, 0 FROM (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) v(p)
  UNION ALL SELECT p, CASE WHEN {_ETA('(lo+hi)/2')} < ln(p)-ln(1-p) THEN (lo+hi)/2 ELSE lo END, CASE WHEN {_ETA('(lo+hi)/2')} < ln(p)-ln(1-p) THEN hi ELSE (lo+hi)/2 END, k+1 FROM bi, n3 WHERE k < 60)
SELECT round(p, 6) AS p, round({_sig('lo')}, 6) AS raw FROM bi WHERE k = 60""")(lambda f, s, d: (lambda m: s.createDataFrame([(p, m.point_inverse(p)) for p in (0.1, 0.2, 0.3)], "p double, raw double"))(C.Beta().fit(f)))

query("offset_explicit", f"WITH {frame()} SELECT row_id, round({_sig(LOGIT + '-0.3')}, 6) AS p FROM cal")(lambda f, *_: f.df.select("row_id", T.LogitOffset(delta=-0.3).fit(f).predict(F.col("s")).alias("p")))
_SHIFT = newton(["1.0"], y="0.2", offset=LOGIT, name="no")
query("offset_target_mean", f"WITH {frame()}, {_SHIFT} SELECT round(b0, 6) AS delta, round(sum(w*s)/sum(w), 6) AS pre_mean, round(sum(w*{_sig(LOGIT + '+b0')})/sum(w), 6) AS post_mean FROM cal, no GROUP BY b0")(
    lambda f, *_: (lambda o: {"delta": o.delta, "pre_mean": o.before, "post_mean": o.after})(T.LogitOffset(target_mean=0.2).fit(f))
)
_AFTER = f"af AS MATERIALIZED (SELECT row_id, w, y, {_sig(LOGIT + '+b0')} AS s FROM cal, no)"
_GUARD = lambda slope, inter, z: f"round({slope}, 5) AS {{0}}_slope, round({inter}, 5) AS {{0}}_intercept, round({_two_sided(z)}, 5) AS {{0}}_spiegelhalter_p, {slope} BETWEEN 0.9 AND 1.1 AS {{0}}_slope_ok, abs({inter}) <= 0.1 AS {{0}}_intercept_ok, abs({z}) < 1.959964 AS {{0}}_spiegelhalter_ok, ({slope} BETWEEN 0.9 AND 1.1) AND abs({inter}) <= 0.1 AND abs({z}) < 1.959964 AS {{0}}_all_ok"
query("offset_audit", f"""WITH {frame()}, {newton(['1.0'], y='0.25', offset=LOGIT, name='no')}, {_AFTER}, {_SLO}, {_INT}, {newton(['1.0', LOGIT], source='af', name='ms')}, {newton(['1.0'], offset=LOGIT, source='af', name='mi')},
zb AS MATERIALIZED (SELECT {_SZ} AS z, sum(w*s)/sum(w) AS m FROM cal), za AS MATERIALIZED (SELECT {_SZ} AS z, sum(w*s)/sum(w) AS m FROM af)
SELECT round(no.b0, 5) AS delta, round(zb.m, 5) AS pre_mean, round(za.m, 5) AS post_mean, {_GUARD('ns.b1', 'ni.b0', 'zb.z').format('before')}, {_GUARD('ms.b1', 'mi.b0', 'za.z').format('after')} FROM no, ns, ni, ms, mi, zb, za""", digits=5)(lambda f, *_: T.LogitOffset(target_mean=0.25).fit(f).audit(f))


def _phi(f: Frame) -> DataFrame:
    z = logit(F.col("s"))
    return f.df.select("row_id", F.array(z * 0.5, z * 0.3, z * 0.2 + 1.0).alias("phi"), F.lit(-1.0).alias("base"))


def _attributed(df: DataFrame) -> DataFrame:
    return df.select("row_id", F.col("phi_adj")[0].alias("phi0"), F.col("phi_adj")[2].alias("phi2"), "base_adj", "target")


query("attribution_affine", f"WITH {frame()}, {PLATT} SELECT row_id, round(b1*0.5*{LOGIT}, 6) AS phi0, round(b1*(0.2*{LOGIT}+1), 6) AS phi2, round(b0-b1, 6) AS base_adj, round(b0+b1*{LOGIT}, 6) AS target FROM cal, pl")(
    lambda f, *_: _attributed(T.adjust_attributions(_phi(f), C.Platt().fit(f)))
)
query("attribution_aumann_shapley", f"""WITH {frame()}, {PLATT}, t AS (SELECT row_id, {LOGIT} AS z, b0, b1 FROM cal, pl)
SELECT row_id, round(0.5*z*b1, 6) AS phi0, round((0.2*z+1)*b1, 6) AS phi2, round(b0-b1, 6) AS base_adj, round(b0+b1*z, 6) AS target FROM t""")(lambda f, *_: _attributed(T.adjust_attributions(_phi(f), C.Platt().fit(f), method="aumann-shapley")))

_FACTOR = f"(CASE WHEN abs(z+1) < 1e-8 THEN ({_ETA('-0.9999')}-{_ETA('-1.0001')})/2e-4 ELSE ({_ETA('z')}-{_ETA('-1.0')})/(z+1) END)"
query("attribution_beta", f"""WITH {frame()}, {_BETA}, t AS MATERIALIZED (SELECT row_id, {LOGIT} AS z FROM cal)
SELECT row_id, round(0.5*z*{_FACTOR}, 5) AS phi0, round((0.2*z+1)*{_FACTOR}, 5) AS phi2, round({_ETA('z')}-(z+1)*{_FACTOR}, 5) AS base_adj, round({_ETA('z')}, 5) AS target FROM t, n3""", digits=5)(
    lambda f, *_: _attributed(T.adjust_attributions(_phi(f), C.Beta().fit(f)))
)
query("attribution_probability", f"""WITH {frame()}, {PLATT}, t AS MATERIALIZED (SELECT row_id, s, {_sig('b0+b1*' + LOGIT)} AS p, {_sig('b0+b1*(ln(0.3)-ln(0.7))')} AS p0 FROM cal, pl)
SELECT row_id, round(0.5*(p-p0), 6) + 0.0::DOUBLE AS phi0, round(0.2*(p-p0), 6) + 0.0::DOUBLE AS phi2, round(p0, 6) AS base_adj, round(p, 6) AS target FROM t""")(
    lambda f, *_: _attributed(T.adjust_attributions(f.df.select("row_id", F.array((F.col("s") - 0.3) * 0.5, (F.col("s") - 0.3) * 0.3, (F.col("s") - 0.3) * 0.2).alias("phi"), F.lit(0.3).alias("base")), C.Platt().fit(f), scale="probability"))
)

_FOLD = f"""WITH {frame()}, fo AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY (row_id*7919+42) % 100003, row_id) - 1) % 5 AS fold FROM cal),
e AS MATERIALIZED (SELECT j AS fold, list_sort(list_distinct(quantile_cont(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e FROM fo, range(5) t(j) WHERE fo.fold <> j GROUP BY j),
a AS MATERIALIZED (SELECT e.fold, len(list_filter(e, lambda v: v <= s)) AS bin, (sum(w*y)+0.5)/(sum(w)+1) AS p FROM fo JOIN e ON fo.fold <> e.fold GROUP BY e.fold, bin)"""
query("cv_oof_histogram", f"{_FOLD} SELECT row_id, CAST(fo.fold AS BIGINT) AS fold, round(p, 6) AS p FROM fo JOIN e ON e.fold = fo.fold JOIN a ON a.fold = fo.fold AND a.bin = len(list_filter(e, lambda v: v <= s))")(
    lambda f, *_: T.out_of_fold(f, C.Histogram).select("row_id", "fold", "p")
)


def _candidate(j: int) -> str:
    """Histogram, Platt and temperature fitted off fold j, and the fold's rows by each."""
    off = f"of{j} AS MATERIALIZED (SELECT * FROM fo WHERE fold <> {j})"
    smoothed = f"tg{j} AS MATERIALIZED (SELECT c.*, CASE WHEN y > 0.5 THEN (k+1)/(k+2) ELSE 1/(n-k+2) END AS t FROM of{j} c, (SELECT sum(y) AS k, CAST(count(*) AS DOUBLE) AS n FROM of{j}))"
    fits = f"{newton(['1.0', LOGIT], y='t', source=f'tg{j}', name=f'pm{j}')}, {newton([LOGIT], source=f'of{j}', name=f'tm{j}')}, {binned(10, w='w', source=f'of{j}', name=f'hb{j}')}"
    bins = f"hr{j} AS MATERIALIZED (SELECT row_id, (k+0.5)/(x.w+1) AS h FROM (SELECT *, len(list_filter(e, lambda v: v <= s)) AS bin FROM fo, hb{j}_e WHERE fold = {j}) c JOIN hb{j} x USING (bin))"
    rows = f"ho{j} AS MATERIALIZED (SELECT fold, y, w, {_sig('p.b0+p.b1*' + LOGIT)} AS platt, {_sig('t.b0*' + LOGIT)} AS temperature, h AS histogram FROM fo JOIN hr{j} USING (row_id), pm{j} p, tm{j} t WHERE fold = {j})"
    return ", ".join([off, smoothed, fits, bins, rows])


_NAMED = ("histogram", "platt", "temperature")
_HELD = ", ".join(f"v_{m} AS MATERIALIZED (SELECT fold, y, w, {m} AS s FROM every)" for m in _NAMED)
_CHECKS = ", ".join(f"{newton(['1.0', LOGIT], source=f'v_{m}', name=f'gs_{m}')}, {newton(['1.0'], offset=LOGIT, source=f'v_{m}', name=f'gi_{m}')}" for m in _NAMED)
_RANKS = {"histogram": 10, "platt": 2, "temperature": 1}
_RESULT = " UNION ALL ".join(
    f"SELECT '{m}' AS method, {_RANKS[m]} AS rank, (SELECT avg(l) FROM fl_{m}) AS mean, (SELECT stddev_samp(l) FROM fl_{m}) AS sd, gs_{m}.b1 BETWEEN 0.9 AND 1.1 AND abs(gi_{m}.b0) <= 0.1 AND abs(z) < 1.959964 AS ok FROM gs_{m}, gi_{m}, (SELECT {_SZ} AS z FROM v_{m})" for m in _NAMED
)
_LOSSES = ", ".join(f"fl_{m} AS MATERIALIZED (SELECT fold, {_LL} AS l FROM v_{m} GROUP BY fold)" for m in _NAMED)
_SELECT = f"""WITH {frame()}, fo AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY (row_id*7919+42) % 100003, row_id) - 1) % 5 AS fold FROM cal), {', '.join(map(_candidate, range(5)))},
every AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM ho{j}' for j in range(5))}), {_HELD}, {_CHECKS}, {_LOSSES}, re AS MATERIALIZED ({_RESULT}),
be AS MATERIALIZED (SELECT mean, sd FROM re ORDER BY mean LIMIT 1), ch AS MATERIALIZED (SELECT re.method FROM re, be WHERE re.mean <= be.mean + be.sd/sqrt(5.0) ORDER BY rank, re.mean LIMIT 1)
SELECT re.method, round(mean, 6) AS score_mean, round(sd, 6) AS score_sd, ok AS guardrails_ok, re.method = ch.method AS chosen FROM re, ch"""


@query("selector_report", _SELECT)
def _selector(f, spark, d):
    report, _, chosen = T.select(f, {"histogram": C.Histogram, "platt": C.Platt, "temperature": C.Temperature})
    return spark.createDataFrame([(r["method"], r["mean"], r["sd"], r["guardrails_ok"], r["method"] == chosen) for r in report], "method string, score_mean double, score_sd double, guardrails_ok boolean, chosen boolean")



def _rates(df: DataFrame) -> F.Column:
    """A model to be calibrated: smoothed event rates by quarter of the raw score."""
    rate = {r["b"]: r["q"] for r in df.groupBy(F.floor(F.col("s") * 4).alias("b")).agg(((F.sum("y") + 0.5) / (F.count("*") + 1)).alias("q")).collect()}
    return F.element_at(F.array(*[F.lit(float(rate.get(b, 0.5))) for b in range(5)]), (F.floor(F.col("s") * 4) + 1).cast("int"))


_CVW = f"""WITH {frame()}, fo AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY (row_id*7919+42) % 100003, row_id) - 1) % 5 AS fold FROM cal),
g AS MATERIALIZED (SELECT j AS fold, floor(s*4) AS b, (sum(y)+0.5)/(count(*)+1) AS q FROM fo, range(5) t(j) WHERE fo.fold <> j GROUP BY j, floor(s*4)),
ov AS MATERIALIZED (SELECT row_id, g.q AS s, y, w FROM fo JOIN g ON g.fold = fo.fold AND g.b = floor(fo.s*4)),
al AS MATERIALIZED (SELECT floor(s*4) AS b, (sum(y)+0.5)/(count(*)+1) AS q FROM cal GROUP BY 1)"""
query("wrapper_cv_pooled", f"{_CVW}, {newton(['1.0', LOGIT], source='ov', name='nw')} SELECT row_id, round({_sig('b0+b1*(ln(q)-ln(1-q))')}, 5) AS p FROM cal JOIN al ON b = floor(s*4), nw", digits=5)(
    lambda f, *_: T.CalibratedModel(_rates, lambda: C.Beta("ab"), "cv").fit(f.df, "y", "row_id", "w").transform(f.df).select("row_id", "p")
)
def _member(j: int) -> str:
    """A fold's model on the other folds, and a Platt map of its scores on that fold."""
    held = f"he{j} AS MATERIALIZED (SELECT row_id, w, y, {_sig('b0+b1*s')} AS s FROM fo, mo{j} WHERE fold = {j})"
    smoothed = f"tg{j} AS MATERIALIZED (SELECT c.*, CASE WHEN y > 0.5 THEN (k+1)/(k+2) ELSE 1/(n-k+2) END AS t FROM he{j} c, (SELECT sum(y) AS k, CAST(count(*) AS DOUBLE) AS n FROM he{j}))"
    return f"tr{j} AS MATERIALIZED (SELECT s, y FROM fo WHERE fold <> {j}), {newton(['1.0', 's'], w='1.0', source=f'tr{j}', name=f'mo{j}')}, {held}, {smoothed}, {newton(['1.0', LOGIT], y='t', source=f'tg{j}', name=f'pm{j}')}"


_MEMBERS = ", ".join(_member(j) for j in range(5))
_MEAN = " + ".join(_sig(f"pm{j}.b0+pm{j}.b1*(mo{j}.b0+mo{j}.b1*s)") for j in range(5))
query("wrapper_cv_ensemble", f"""WITH {frame()}, fo AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY (row_id*7919+42) % 100003, row_id) - 1) % 5 AS fold FROM cal), {_MEMBERS}
SELECT row_id, round(({_MEAN})/5, 6) AS p FROM cal, {', '.join(f'pm{j}, mo{j}' for j in range(5))}""")(lambda f, *_: T.CalibratedModel(T.logistic_trainer(["s"], "y"), C.Platt, "cv", ensemble=True).fit(f.df, "y", "row_id", "w").transform(f.df).select("row_id", "p"))
query("prefit_wrapper", f"WITH {frame()}, {PLATT} SELECT row_id, round({_sig('b0+b1*' + LOGIT + '+0.1')}, 6) AS p FROM cal, pl")(
    lambda f, *_: T.CalibratedModel(F.col("s"), C.Platt).fit(f.df, "y", "row_id", "w").offset_to(delta=0.1).transform(f.df).select("row_id", "p")
)
query("weighted_quantile", f"""WITH {frame()}, t AS MATERIALIZED (SELECT s, (sum(w) OVER (ORDER BY s, row_id ROWS UNBOUNDED PRECEDING) - w/2) / sum(w) OVER () AS q FROM cal),
k AS (SELECT q0 FROM (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) v(q0))
SELECT q0 AS q, round((SELECT max_by(s, q) FROM t WHERE q <= q0) + ((SELECT min_by(s, q) FROM t WHERE q > q0) - (SELECT max_by(s, q) FROM t WHERE q <= q0)) * (q0 - (SELECT max(q) FROM t WHERE q <= q0)) / ((SELECT min(q) FROM t WHERE q > q0) - (SELECT max(q) FROM t WHERE q <= q0)), 6) AS value FROM k""")(
    lambda f, *_: M.weighted_quantiles(_whole(f), (0.1, 0.5, 0.9))
)
query("validated", f"WITH {frame()} SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS events, round(sum(w), 6) AS weight FROM cal")(
    lambda f, s, d: Frame.bind(orders_frame(s, d), weight="w").df.agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("events"), F.sum("w").alias("weight"))
)
query("wrapper_interval_inverse", f"WITH {frame()}, {PLATT} SELECT round({_sig('(ln(0.2)-ln(0.8)+0.05-0.1-b0)/b1')}, 6) AS raw_lo, round({_sig('(ln(0.4)-ln(0.6)-0.05-0.1-b0)/b1')}, 6) AS raw_hi FROM pl")(
    lambda f, *_: dict(zip(("raw_lo", "raw_hi"), T.interval_to_raw(T.CalibratedModel(F.col("s"), C.Platt).fit(f.df, "y", "row_id", "w").offset_to(delta=0.1), 0.2, 0.4, buffer_logit=0.05)))
)
query("plot_data_comparison", f"""WITH {frame()}, {PLATT}, pg AS MATERIALIZED (SELECT row_id, w, y, {_sig('b0+b1*' + LOGIT)} AS s FROM cal, pl), {binned(10, w='w')}, {binned(10, w='w', source='pg', name='h')}
SELECT panel, CAST(bin AS BIGINT) AS bin, n AS count, round(p, 5) AS pred_mean, round(r, 5) AS event_rate FROM (SELECT 'before' AS panel, * FROM b UNION ALL SELECT 'after', * FROM h)""", digits=5)(
    lambda f, *_: T.comparison(f, Frame(C.Platt().fit(f).transform(f.df, out="s"), f.weighted)).select("panel", "bin", "count", "pred_mean", "event_rate")
)
query("pd_portfolio", None)(lambda f, s, d: portfolio(s, 2000))
query("plot_data_rug", f"WITH {frame()}, t AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS place, count(*) OVER () AS n FROM cal) SELECT place, round(s, 6) AS s FROM t WHERE place % CAST(ceil(n/1000.0) AS BIGINT) = 0")(lambda f, *_: T.rug(f.df))
query("plot_data_ecce_band", f"{_WALK} SELECT row_id, round(frac, 6) AS frac, round(c, 6) AS cumdev, round(-2*sd, 6) AS band_low, round(2*sd, 6) AS band_high FROM t")(lambda f, *_: T.ecce_band(f))
_LG = lambda x: f"round(ln(greatest({x}, 1e-12::DOUBLE))-ln(1-least({x}, 1-1e-12::DOUBLE)), 6)"
query("plot_data_reliability", f"WITH {frame()}, {binned(10, w='w')}, x AS ({_REL}) SELECT bin, count, pred_mean_logit AS x, {_LG('r')} AS y FROM x JOIN (SELECT CAST(bin AS BIGINT) AS bin, r FROM b) USING (bin) WHERE r > 0 AND r < 1")(
    lambda f, *_: T.reliability_points(f).select("bin", "count", "x", "y")
)
query("plot_data_offset", "WITH t AS (SELECT range AS point, ln(0.001::DOUBLE)-ln(0.999::DOUBLE) AS lo FROM range(200)) SELECT point, round(lo-lo*point/199, 6) AS before, round(lo-lo*point/199-0.3, 6) AS after FROM t")(
    lambda f, s, d: T.offset_line(s, T.LogitOffset(delta=-0.3))
)


@query("windowed_scores", f"""SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(avg(-(y*ln(s)+(1-y)*ln(1-s))), 6) AS log_loss, round(avg((s-y)*(s-y)), 6) AS brier
FROM (SELECT ts, 0.05::DOUBLE + 0.9::DOUBLE * CAST((event_id*7919) % 1009 AS DOUBLE)/1009 AS s, CAST(event_id % 2 AS DOUBLE) AS y FROM events) GROUP BY 1""")
def _windows(f, spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    s = F.lit(0.05) + F.lit(0.9) * ((F.col("event_id") * 7919) % 1009).cast("double") / 1009
    return windowed_scores(e.select("ts", s.alias("s"), (F.col("event_id") % 2).cast("double").alias("y"))).select("start", "n", "log_loss", "brier")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability by bin before and after a Platt map."""
    f = _cal(spark, sf_dir)
    after = Frame(f.df.withColumn("s", C.Platt().fit(f).predict(F.col("s"))), True)
    return M.reliability(f).withColumn("stage", F.lit("before")).unionByName(M.reliability(after).withColumn("stage", F.lit("after")))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


