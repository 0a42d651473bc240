"""Values worked out by hand, properties, and errors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import special
from plumbline.operators import calibrators as C
from plumbline.operators import metrics as M
from plumbline.operators import stages as T
from plumbline.operators.frame import Frame
from plumbline.operators.solvers import loess, pava
from plumbline.sources.tables import portfolio


def frame(spark, s, y, w=None, grade=None):
    rows = [(i, float(a), float(b), float(w[i]) if w else 1.0, grade or "g") for i, (a, b) in enumerate(zip(s, y))]
    return Frame.bind(spark.createDataFrame(rows, "row_id long, s double, y double, w double, grade string"), weight="w" if w else None, by=("grade",))


def whole(f):
    return Frame(f.df, f.weighted)


def values(f, model):
    return [r["p"] for r in model.fit(f).transform(f.df).orderBy("row_id").collect()]


def test_isotonic_by_hand(spark):
    f = frame(spark, [0.1, 0.2, 0.3, 0.4, 0.5], [0, 1, 0, 0, 1])
    model = C.Isotonic()
    assert values(f, model) == pytest.approx([0, 1 / 3, 1 / 3, 1 / 3, 1])
    assert len(model.mean) == 3
    assert model.interval_inverse(0.2, 0.9) == pytest.approx((0.2, 0.5))
    assert values(frame(spark, [0.3, 0.3, 0.3, 0.7, 0.7], [0, 1, 0, 1, 1]), C.Isotonic())[0] == pytest.approx(1 / 3)


def test_isotonic_unattainable(spark):
    model = C.Isotonic().fit(frame(spark, [0.1, 0.2, 0.3, 0.4], [0, 1, 1, 0]))
    with pytest.raises(C.Unattainable, match="does not intersect"):
        model.interval_inverse(2 / 3 + 0.05, 1.0)


def test_histogram_by_hand(spark):
    f = frame(spark, [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9], [0, 0, 1, 0, 1, 1, 0, 1])
    assert sorted(set(values(f, C.Histogram(2, shrinkage=None)))) == pytest.approx([0.25, 0.75])
    assert sorted(set(values(f, C.Histogram(2)))) == pytest.approx([0.3, 0.7])


def test_scores_by_hand(spark):
    f = whole(frame(spark, [0.8, 0.4], [1, 0]))
    assert M.log_loss(f).first()[0] == pytest.approx(-(math.log(0.8) + math.log(0.6)) / 2)
    assert M.brier_score(f).first()[0] == pytest.approx(0.1)
    f = whole(frame(spark, [0.8, 0.4], [1, 0], [3, 1]))
    assert M.log_loss(f).first()[0] == pytest.approx(-(3 * math.log(0.8) + math.log(0.6)) / 4)


def test_binned_by_hand(spark):
    f = whole(frame(spark, [0.1, 0.1, 0.9, 0.9], [0, 1, 1, 1]))
    assert M.ece(f, 2).first()[0] == pytest.approx(0.25)
    assert M.ece(f, 2, norm="max").first()[0] == pytest.approx(0.4)
    assert M.ece(f, 2, norm="l2").first()[0] == pytest.approx(math.sqrt((0.16 + 0.01) / 2))


def test_ecce_by_hand(spark):
    got = M.ecce(whole(frame(spark, [0.2, 0.4, 0.6], [0, 1, 1]))).first()
    assert tuple(got) == pytest.approx((0.8 / 3, 1.4 / 9))
    curve = M.ecce_curve(whole(frame(spark, [0.2, 0.4, 0.4, 0.8], [0, 0, 1, 1]))).orderBy("frac").collect()
    assert [r["cumdev"] for r in curve] == pytest.approx(np.cumsum([-0.2, -0.4, 0.6, 0.2]) / 4)


def test_skce_by_hand(spark):
    f = whole(frame(spark, [0.8, 0.4, 0.6], [1, 0, 1]))
    assert M.skce(f, 1.0) == pytest.approx(-0.0794160426)
    assert M.skce(f, 1.0, biased=True) == pytest.approx(0.0270559716)


def _terms(s, y, kernel, width, x=None):
    s, y = np.array(s), np.array(y)
    x, r = s if x is None else x, y - s
    d = np.abs(x[:, None] - x)
    return 2 * (np.exp(-d / width) if kernel == "laplace" else np.exp(-(d**2) / (2 * width**2))) * np.outer(r, r)


@pytest.mark.parametrize("kernel", ["laplace", "gaussian"])
@pytest.mark.parametrize("scale", ["probability", "logit"])
def test_skce_options(spark, kernel, scale):
    rng = np.random.default_rng(5)
    s = np.round(rng.uniform(0.05, 0.95, 60), 1)
    y = (rng.uniform(size=60) < s).astype(float)
    x = s if scale == "probability" else np.log(s) - np.log1p(-s)
    width = np.median(np.abs(x[:, None] - x)[np.triu_indices(60, 1)])
    h = _terms(s, y, kernel, width, x)
    f = whole(frame(spark, s, y))
    assert M.skce(f, kernel=kernel, scale=scale) == pytest.approx((h.sum() - np.trace(h)) / (60 * 59))
    assert M.skce(f, biased=True, kernel=kernel, scale=scale) == pytest.approx(h.mean())


@pytest.mark.parametrize("width", [1e-4, 0.02, 5.0])
def test_skce_over_partitions_and_batches(spark, width):
    """Stretches joined across batches and partitions give the sum over all pairs, ties included."""
    from plumbline.operators import kernel

    rng = np.random.default_rng(15)
    s = np.r_[np.round(rng.uniform(0.01, 0.99, 300), 2), rng.uniform(0.01, 0.99, 300), [0.4] * 100]
    y = (rng.uniform(size=len(s)) < s).astype(float)
    f = whole(frame(spark, s, y))
    h = _terms(s, y, "laplace", width)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        pairs, own, n = kernel._laplace_pairs(f, F.col("s"), width)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (2 * pairs, 2 * own, n) == pytest.approx((h.sum(), np.trace(h), len(s)), rel=1e-10)


def test_laplace_sums_in_lanes():
    from plumbline.operators.kernel import _laplace_sums

    rng = np.random.default_rng(16)
    x = np.sort(np.round(rng.uniform(0, 40, 200), 1))
    v = rng.normal(size=(200, 3))
    for width in (0.01, 0.5, 100.0):
        near = np.exp(-np.abs(x[:, None] - x) / width)
        assert _laplace_sums(x, v, width) == pytest.approx(near @ v, abs=1e-11)
        assert _laplace_sums(x, v[:, 0], width) == pytest.approx(near @ v[:, 0], abs=1e-11)


def test_skce_pairs(spark):
    import hashlib

    rng = np.random.default_rng(6)
    s, y = rng.uniform(0.1, 0.9, 41), rng.integers(0, 2, 41)
    order = sorted(range(41), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
    h = _terms(s, y, "laplace", 0.3)
    want = [h[a, b] for a, b in zip(order[:40:2], order[1:40:2])]
    f = whole(frame(spark, s, y))
    got = M.skce_linear(f, 0.3).first()
    assert tuple(got) == pytest.approx((20, np.mean(want), np.std(want, ddof=1)))
    test = M.skce_test(f, "asymptotic", bandwidth=0.3)
    assert test["p_value"] == pytest.approx(0.5 * math.erfc(math.sqrt(20) * np.mean(want) / np.std(want, ddof=1) / math.sqrt(2)))


def test_ranks_span_buckets(spark):
    from plumbline.operators.kernel import ranked

    rows = spark.range(1000).withColumn("v", F.col("id") * 7 % 1000)
    got = ranked(rows, F.floor(F.col("v") / 90), ["v"]).collect()
    assert all(r["place"] == r["v"] for r in got)


def test_skce_resamples(spark):
    """The statistics of the drawn counts equal those of the centred matrix written out."""
    from plumbline.operators import kernel

    rng = np.random.default_rng(7)
    s = np.round(rng.uniform(0.1, 0.9, 80), 1)
    y = (rng.uniform(size=80) < s).astype(float)
    f = whole(frame(spark, s, y))
    x, r, n = kernel._classes(f, F.col("s"), 1000)
    got = kernel._resampled(f, x, r, n, "laplace", 0.2, 150, 3)
    assert len(got) == 150 and n.sum() == 80
    rows = np.repeat(np.arange(len(x)), n.astype(int))
    h = 2 * np.exp(-np.abs(x[rows, None] - x[rows]) / 0.2) * np.outer(r[rows], r[rows])
    c = h.mean(axis=1)
    centred = h - c[:, None] - c + h.mean()
    first = np.r_[0, np.cumsum(n.astype(int))[:-1]]
    drawn = np.concatenate([np.random.default_rng([3, part]).multinomial(80, n / 80, size=size) for part, size in ((0, 128), (1, 22))])
    for t, counts in zip(got, drawn):
        v = np.zeros(80)
        v[first] = counts  # rows of a class are alike, so its first stands for all
        assert t == pytest.approx((v @ centred @ v - v @ np.diag(centred)) / 80, abs=1e-9)


def test_skce_test_decides(spark):
    rng = np.random.default_rng(8)
    s = rng.uniform(0.05, 0.95, 400)
    good, bad = (rng.uniform(size=400) < s).astype(float), (rng.uniform(size=400) < s**3).astype(float)
    assert M.skce_test(whole(frame(spark, s, good)), replicates=199)["p_value"] > 0.05
    got = M.skce_test(whole(frame(spark, s, bad)), replicates=199)
    assert got["p_value"] == 0.005 and got["estimator"] == "uq" and 0 < got["p_value_bound"] <= 1
    assert M.skce_test(whole(frame(spark, s, bad)), "asymptotic")["p_value"] < 0.05
    with pytest.raises(ValueError, match="method"):
        M.skce_test(whole(frame(spark, s, bad)), "exact")
    with pytest.raises(ValueError, match="identical"):
        M.skce(whole(frame(spark, [0.5] * 4, [0, 1, 0, 1])))


def test_grades_by_hand(spark):
    r = M.grade_backtest(frame(spark, [0.5, 0.5], [1, 0])).first()
    assert r["p_exact"] == pytest.approx(0.75) and r["p_jeffreys"] == pytest.approx(0.5)


def test_special_functions():
    assert special.betainc(2, 3, 0.4) == pytest.approx(0.5248)
    assert special.gammainc(1, 2) == pytest.approx(1 - math.exp(-2))
    assert special.chi2_ppf(0.95, 2) == pytest.approx(-2 * math.log(0.05))
    assert special.norm_cdf(special.norm_ppf(0.975)) == pytest.approx(0.975)
    assert special.betainc(2.5, 4, special.beta_ppf(0.3, 2.5, 4)) == pytest.approx(0.3)


def test_pava_merges_only_falls():
    one = np.ones(3)
    assert len(pava(np.arange(3.0), np.arange(3.0), one, np.array([0.5, 0.5, 0.5]), one)) == 3


def test_loess_reproduces_a_line():
    x = np.linspace(0, 1, 50)
    assert loess(x, np.ones_like(x), 2 * x + 1, np.array([0.1, 0.5, 0.9])) == pytest.approx([1.2, 2.0, 2.8])


def test_venn_abers_equals_refits(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.uniform(0.02, 0.98, 40), 2)
    y = (rng.random(40) < s).astype(float)
    w = rng.uniform(0.3, 4, 40)
    order = np.argsort(s, kind="stable")
    c, z = np.r_[0, np.cumsum(w[order])], np.r_[0, np.cumsum((w * y)[order])]
    for label in (0.0, 1.0):
        slow = [max(min((z[j] + label - z[i]) / (c[j] + 1 - c[i]) for j in range(k, len(c))) for i in range(k + 1)) for k in range(len(c))]
        assert C._inserted(c.tolist(), z.tolist(), label) == pytest.approx(slow, abs=1e-12)


def test_ivap_query_by_brute_force(spark):
    """The registered query over its whole table, against all starts and ends written out."""
    from plumbline.plans import catalogue

    where = "/root/testdata/sf0.001"
    rows = catalogue._cal(spark, where).df.orderBy("s", "row_id").collect()
    s, y, w = (np.array([r[c] for r in rows]) for c in ("s", "y", "w"))
    c, z = np.r_[0, np.cumsum(w)], np.r_[0, np.cumsum(w * y)]
    both = []
    for label in (0.0, 1.0):
        with np.errstate(all="ignore"):  # ends before starts are set aside
            slope = (z[None, :] + label - z[:, None]) / (c[None, :] + 1 - c[:, None])
        slope[np.tril_indices(len(c), -1)] = np.inf
        least = np.minimum.accumulate(slope[:, ::-1], axis=1)[:, ::-1]
        both.append(np.where(np.triu(np.ones_like(least)) > 0, least, -np.inf).max(axis=0))
    k = np.searchsorted(s, s, "left")
    want = {r["row_id"]: (a, b, b / (1 - a + b)) for r, a, b in zip(rows, both[0][k], both[1][k])}
    got = {r["row_id"]: (r["p0"], r["p1"], r["p"]) for r in catalogue.queries()["ivap"](spark, where).collect()}
    assert got.keys() == want.keys() and len(got) == 1500
    assert [v for i in sorted(got) for v in got[i]] == pytest.approx([v for i in sorted(want) for v in want[i]], abs=2e-6)


@pytest.mark.parametrize("make", [C.Platt, C.Temperature, C.Beta, lambda: C.Beta("a"), lambda: C.Beta("ab"), C.Spline, C.BBQ, C.ENIR, C.ScalingBinning, C.CenteredIsotonic, C.VennAbers, lambda: C.CrossVennAbers(2)])
def test_column_equals_driver_map(spark, make):
    f = whole(Frame.bind(portfolio(spark, 400, event_rate=0.2)))
    model = make().fit(f)
    rows = model.transform(f.df).select("s", "p").collect()
    assert [r["p"] for r in rows] == pytest.approx(model.local(np.array([r["s"] for r in rows])), abs=1e-9)
    assert all(0 <= r["p"] <= 1 for r in rows)
    assert model.interpret(spark).count() >= 1


def test_inverse_round_trip(spark):
    f = whole(Frame.bind(portfolio(spark, 1000, event_rate=0.2)))
    for model in (C.Platt().fit(f), C.Beta().fit(f)):
        for p in (0.05, 0.2):
            assert model.local(np.array([model.point_inverse(p)]))[0] == pytest.approx(p, rel=1e-8)
    with pytest.raises(ValueError, match="buffer"):
        C.Platt().fit(f).interval_inverse(0.2, 0.2, buffer_logit=0.5)
    with pytest.raises(RuntimeError):
        C.Platt().transform(f.df)
    with pytest.raises(ValueError, match="variant"):
        C.Beta("x")


def test_validation(spark):
    bad = lambda rows: Frame.bind(spark.createDataFrame(rows, "row_id long, s double, y double"))
    with pytest.raises(ValueError, match="both classes"):
        bad([(1, 0.5, 1.0)])
    with pytest.raises(ValueError, match="scores"):
        bad([(1, 1.5, 1.0), (2, 0.2, 0.0)])
    with pytest.raises(ValueError, match="labels"):
        bad([(1, 0.5, 2.0), (2, 0.2, 0.0)])
    with pytest.raises(ValueError, match="exactly one"):
        T.LogitOffset()
    with pytest.raises(ValueError, match="log_loss"):
        T.select(None, scoring="nope")


def test_attributions_add_up(spark):
    f = whole(Frame.bind(portfolio(spark, 500, event_rate=0.2)))
    df = f.df.select(F.array(F.col("s"), F.col("s") * 2 - 1).alias("phi"), F.lit(-1.0).alias("base"))
    for model in (C.Platt().fit(f), C.Beta().fit(f)):
        out = T.adjust_attributions(df, model)
        gap = out.select(F.max(F.abs(F.aggregate("phi_adj", F.lit(0.0), lambda a, v: a + v) + F.col("base_adj") - F.col("target")))).first()[0]
        assert gap < 1e-9
    with pytest.raises(ValueError, match="affine"):
        T.adjust_attributions(df, C.Beta().fit(f), method="affine")


def test_no_leakage(spark):
    f = whole(Frame.bind(portfolio(spark, 300, event_rate=0.3)))
    counts = C.folds(f.df, 5).groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("d")).collect()
    assert len(counts) == 5 and sum(r["n"] for r in counts) == 300 and all(r["n"] == r["d"] for r in counts)


def _applicants(spark, n=1500):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(n, 2))
    y = rng.uniform(size=n) < 1 / (1 + np.exp(-(-1 + 1.2 * x[:, 0] - 0.6 * x[:, 1])))
    return spark.createDataFrame([(i, float(a), float(b), int(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "id long, a double, b double, bad int")


def test_wrapper_trains_on_other_folds(spark):
    """Each fold is scored by a model that has not seen it; the last training of the pooled flow sees all rows."""
    seen = []

    def spy(df):
        ids = {r["id"] for r in df.select("id").collect()}
        seen.append(ids)
        return F.when(F.col("id").isin(sorted(ids)), 0.9).otherwise(0.1 + F.col("id") % 7 / 100)

    df = _applicants(spark, 200)
    model = T.CalibratedModel(spy, C.Platt, "cv", cv=4).fit(df, "bad", "id")
    assert model.frame.df.count() == 200 and model.frame.df.where("s = 0.9").count() == 0
    assert sorted(map(len, seen))[-1] == 200 and len(seen) == 5


def test_wrapper_flows(spark):
    df = _applicants(spark)
    trainer = T.logistic_trainer(["a", "b"], "bad")
    rate = df.agg(F.avg("bad")).first()[0]
    for ensemble in (False, True):
        model = T.CalibratedModel(trainer, C.Platt, "cv", ensemble=ensemble).fit(df, "bad", "id")
        assert len(model.models) == (5 if ensemble else 1)
        out = model.transform(df)
        assert out.agg(F.avg("p")).first()[0] == pytest.approx(rate, abs=0.01)
        assert (model.affine() is None) == ensemble and model.monotone
        moved = model.offset_to(target_mean=0.5, df=df).transform(df)
        assert moved.agg(F.avg("p")).first()[0] == pytest.approx(0.5, abs=1e-9)
    a, b = T.CalibratedModel(trainer, C.Platt, "cv").fit(df, "bad", "id").affine()
    assert abs(a - 1) < 0.2 and abs(b) < 0.2
    with pytest.raises(TypeError):
        T.CalibratedModel(trainer, C.Platt)
    with pytest.raises(ValueError, match="flow"):
        T.CalibratedModel(F.col("a"), C.Platt, "other")


def test_evaluate_and_intervals(spark):
    f = whole(Frame.bind(portfolio(spark, 1200, event_rate=0.2)))
    got = M.evaluate(f)
    assert tuple(got) == M.CATALOGUE and all(math.isfinite(v) for v in got.values())
    assert got["mce"] == pytest.approx(M.ece(f, norm="max").first()[0]) and got["slope"] == pytest.approx(M.calibration_slope(f))
    assert got["ici"] <= got["emax"] and got["e50"] <= got["e90"] <= got["emax"]
    assert got["spiegelhalter_p"] == pytest.approx(math.erfc(abs(got["spiegelhalter_z"]) / math.sqrt(2)))
    assert list(M.evaluate(f, ["emax", "brier"])) == ["brier", "emax"]
    with pytest.raises(ValueError, match="unknown"):
        M.evaluate(f, ["nope"])
    ends = M.bootstrap(f, 200).first()
    for c in ("log_loss", "brier", "brier_skill", "spiegelhalter_z"):
        assert ends[f"{c}_low"] < got[c] < ends[f"{c}_high"]


def test_weighted_quantiles_with_ties(spark):
    rng = np.random.default_rng(22)
    s, w = np.round(rng.uniform(0.1, 0.9, 300), 1), rng.uniform(0.2, 5, 300)
    s[:150] = 0.4  # half of all rows share a score
    f = whole(frame(spark, s, rng.integers(0, 2, 300), list(w)))
    levels = [0.0, 0.03, 0.2, 0.5, 0.77, 0.99, 1.0]
    got = {r["q"]: r["value"] for r in M.weighted_quantiles(f, levels).collect()}
    assert [got[q] for q in levels] == pytest.approx([M.weighted_quantile(s, q, w) for q in levels])


def test_rug_and_folds_with_one_hot_value(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 5000).alias("s"), (F.col("id") % 100 == 0).cast("double").alias("y"))
    s = sorted(r["s"] for r in df.collect())
    assert [(r["place"], r["s"]) for r in T.rug(df, most=700).orderBy("place").collect()] == [(i, s[i]) for i in range(0, 5000, 8)]
    per = C.folds(df, 5).groupBy("y", "fold").count().collect()
    assert sorted(r["count"] for r in per) == [10] * 5 + [990] * 5
    assert T.rug(df.limit(0)).count() == 0


def test_plot_data(spark):
    f = whole(frame(spark, [0.1, 0.2, 0.3, 0.7, 0.8, 0.9], [0, 0, 1, 0, 1, 1]))
    assert {r["bin"] for r in T.reliability_points(f, 2).collect()} == {0, 1}
    assert T.reliability_points(f, 6).count() == 0  # every rate is 0 or 1
    band = T.ecce_band(f).collect()
    assert len(band) == 6 and all(r["band_low"] == -r["band_high"] for r in band)
    line = T.offset_line(spark, T.LogitOffset(delta=0.25)).orderBy("point").collect()
    assert line[0]["before"] == pytest.approx(math.log(0.001 / 0.999)) and line[-1]["before"] == pytest.approx(0.0, abs=1e-12)
    assert all(r["after"] - r["before"] == pytest.approx(0.25) for r in line)


def test_stream_equals_batch(spark, tmp_path):
    from plumbline.streaming.windows import windowed_scores

    rows = spark.range(200).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), (0.1 + F.col("id") % 8 / 10).alias("s"), (F.col("id") % 2).cast("double").alias("y"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_scores(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r["start"], r["n"], round(r["log_loss"], 9)) for r in df.collect())
    assert key(spark.table("windows")) == key(windowed_scores(rows))
