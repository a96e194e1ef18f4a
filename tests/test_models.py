from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import hmm, linalg
from plumbline.functions.stats import _fisher, exact_percentiles
from plumbline.operators import analogs as an
from plumbline.operators import attribution as at
from plumbline.operators import features as ft
from plumbline.operators import forecast as fc
from plumbline.operators import matrix as mx
from plumbline.operators import pit
from plumbline.operators import portfolio as pf
from plumbline.operators import regime as rg
from plumbline.operators import risk as rk
from tests.conftest import business_days

FEATS = list(ft.DISTANCE_FEATURES)


@pytest.fixture(scope="module")
def analog_rows(spark):
    """800 business days of the distance features, a label and a state."""
    rng = np.random.default_rng(42)
    days = business_days(dt.date(2024, 12, 31), 800)
    x = rng.normal(0, 1, (800, len(FEATS))) * np.linspace(0.5, 3, len(FEATS))
    fwd = rng.normal(0, 0.03, 800)
    state = rng.integers(0, 3, 800)
    rows = [("T", d, *map(float, r), None if i >= 790 else float(f), int(s), 1) for i, (d, r, f, s) in enumerate(zip(days, x, fwd, state))]
    df = spark.createDataFrame(
        rows, "ticker string, effective_date date, " + ", ".join(f"{f} double" for f in FEATS) + ", ret_fwd_10d double, state int, query_state int"
    )
    return an.numbered(df).persist(), x, fwd, state, days


def nearest(x, pool, q, cov, k=30):
    diff = x[pool] - q
    dist = np.sqrt(np.einsum("ij,jk,ik->i", diff, np.linalg.pinv(cov), diff))
    order = np.lexsort((pool, dist))[:k]
    return pool[order], dist[order]


@pytest.mark.parametrize("method", ["sample", "ledoit_wolf"])
def test_analogs_match_numpy(spark, analog_rows, method):
    rows, x, fwd, _, days = analog_rows
    q = an.fit_precision(an.latest_queries(an.prefix_moments(rows)), method=method)
    got = an.find_analogs(rows, q).orderBy("rank").toPandas()
    pool = np.arange(799 - 21)
    cov = np.cov(x[pool], rowvar=False) if method == "sample" else linalg.ledoit_wolf(x[pool])
    want, dist = nearest(x, pool, x[799], cov)
    assert [days.index(d) for d in got["effective_date"]] == want.tolist()
    assert np.allclose(got["distance"], dist)
    summary = an.summarise(an.find_analogs(rows, q)).first()
    assert np.isclose(summary.hit_rate, np.mean(fwd[want] > 0))
    age = np.array([(days[799] - days[i]).days for i in want])
    w = np.exp(-np.log(2) * age / 1260)
    assert np.isclose(summary.effective_n, w.sum() ** 2 / (w**2).sum())


def test_expanding_moments_equal_refitting(spark, analog_rows):
    rows, x, _, _, days = analog_rows
    q = an.fit_precision(an.sampled_queries(an.prefix_moments(rows), trailing=100, every=25))
    got = an.find_analogs(rows, q).where("rank = 1").collect()
    assert len(got) == 4
    for r in got:
        at_row = days.index(r.as_of)
        pool = np.arange(at_row - 21)
        want, dist = nearest(x, pool, x[at_row], linalg.ledoit_wolf(x[pool]), 1)
        assert days.index(r.effective_date) == want[0] and np.isclose(r.distance, dist[0])


def test_within_state_set_uses_the_global_covariance(spark, analog_rows):
    rows, x, _, state, days = analog_rows
    q = an.fit_precision(an.latest_queries(an.prefix_moments(rows)))
    got = an.find_analogs(rows, q, by_state=True).where("analog_set = 'within'").orderBy("rank").collect()
    same = np.flatnonzero(state[:799] == 1)
    want, dist = nearest(x, same[: len(same) - 21], x[799], linalg.ledoit_wolf(x[: 799 - 21]))
    assert [days.index(r.effective_date) for r in got] == want.tolist()
    assert np.allclose([r.distance for r in got], dist)


def test_separation_floor(analog_rows):
    rows, *_ = analog_rows
    with pytest.raises(ValueError):
        an.find_analogs(rows, rows, gap=4)


def test_robust_covariance_ignores_outliers(spark, analog_rows):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    x[:40] += 50
    cov, method = linalg.robust_covariance(x)
    assert method == "mcd" and np.allclose(np.diag(cov), 1, atol=0.35)
    assert linalg.robust_covariance(x[:30])[1] == "ledoit_wolf"
    rows, *_ = analog_rows
    assert an.fit_robust_precision(rows).first()["covariance_method"] == "mcd"


def test_published_covariance_of_any_as_of_date(spark, analog_rows):
    rows, x, _, _, days = analog_rows
    asked = rows.where("row_no IN (100, 400, 700)")
    q = an.fit_robust_precision(rows, asked)
    assert {r.row_no: r.covariance_method for r in q.collect()} == {100: "ledoit_wolf", 400: "mcd", 700: "mcd"}
    for r in an.find_analogs(rows, q).where("rank = 1").collect():
        at_row = days.index(r.as_of)
        pool = np.arange(at_row - 21)
        want, dist = nearest(x, pool, x[at_row], linalg.robust_covariance(x[pool])[0], 1)
        assert days.index(r.effective_date) == want[0] and np.isclose(r.distance, dist[0])


def test_short_history_is_pending(spark, analog_rows):
    rows, *_ = analog_rows
    few = an.numbered(rows.where("row_no > 760").drop("row_no", "n_rows"))
    q = an.fit_precision(an.latest_queries(an.prefix_moments(few)))
    assert an.watchlist(few, an.find_analogs(few, q)).first()["status"] == "pending"


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    hot = np.concatenate([rng.standard_t(2, 5000), np.full(3000, 1.5)])
    rows = [("hot", float(v)) for v in hot] + [("one", 2.0)] + [("pair", 1.0), ("pair", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.97}, most=64).collect()}
    assert np.allclose([got["hot"].a, got["hot"].b, got["hot"].c], np.percentile(hot, [5, 50, 97]))
    assert got["one"].a == got["one"].c == 2.0 and np.isclose(got["pair"].b, 2.5)


def test_fisher_by_enumeration():
    assert np.isclose(_fisher(8, 2, 1, 5), 0.03496503496503495)
    assert np.isclose(_fisher(3, 3, 3, 3), 1.0)
    rng = np.random.default_rng(5)
    for a, b, c, d in rng.integers(0, 60, (200, 4)).tolist():
        lo, hi = max(0, a + c - c - d), min(a + b, a + c)
        p = [math.comb(a + b, x) * math.comb(c + d, a + c - x) for x in range(lo, hi + 1)]
        want = sum(q for q in p if q <= p[a - lo] * (1 + 1e-7)) / sum(p)
        assert np.isclose(_fisher(a, b, c, d), want, rtol=1e-9, atol=1e-300), (a, b, c, d)
    assert 0 < _fisher(500_100_000, 499_900_000, 499_900_000, 500_100_000) < 1e-10
    assert np.isclose(_fisher(10**9, 10**9, 10**9, 10**9), 1.0)


def test_percentiles_of_heaps_outliers_and_null_keys(spark):
    from plumbline.functions import stats

    rng = np.random.default_rng(8)
    heavy = np.concatenate([rng.uniform(0, 1, 3000), [1e300, -1e300], np.exp(rng.normal(0, 40, 500)), np.zeros(700), 1e-9 * rng.uniform(0, 1, 900)])
    rows = [("a", float(v)) for v in heavy] + [(None, float(v)) for v in range(11)] + [("b", None), ("b", float("nan")), ("b", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    seen = []
    kept = stats._values_in
    stats._values_in = lambda counts, cells, by: seen.append(cells) or kept(counts, cells, by)
    try:
        got = {r.k: r for r in exact_percentiles(df, ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.9}, most=32).collect()}
    finally:
        stats._values_in = kept
    for name, q in (("a", 1), ("b", 50), ("c", 90)):
        assert np.isclose(got["a"][name], np.percentile(heavy, q), rtol=1e-12)
        assert np.isclose(got[None][name], np.percentile(range(11), q)) and got["b"][name] == 2.0
    # What is sorted in the end holds few distinct values.
    values = kept(df.groupBy("k", F.col("v").alias("_v")).agg(F.count("*").alias("_c")), seen[-1], ["k"])
    assert values.groupBy("k", "_lo", "_hi").count().agg(F.max("count")).first()[0] <= 32
    assert exact_percentiles(df, [], "v", {"m": 0.5}).first()[0] == pytest.approx(np.nanmedian([r[1] for r in rows if r[1] is not None]))


def test_orthogonal_factors_are_uncorrelated(spark, factor_data):
    factors, _, f, *_ = factor_data
    mixed = factors.withColumn("credit_sensitivity", F.col("credit_sensitivity") + 0.6 * F.col("market_beta"))
    mixed = mixed.withColumn("growth_factor", F.when(F.dayofmonth("effective_date") == 3, None).otherwise(F.col("growth_factor") + 0.4 * F.col("market_beta") + 0.3 * F.col("credit_sensitivity")))
    got = rk.orthogonalise(mixed).orderBy("effective_date").toPandas()
    assert np.allclose(got["market_beta"], f[:, 0])
    corr = got[list(rk.FACTOR_ORDER[:4])].corr().to_numpy()
    assert np.abs(corr - np.eye(4)).max() < 1e-6 + 0.05
    assert abs(got["credit_sensitivity"].corr(got["market_beta"])) < 1e-9


def test_constant_factor_passes_through(spark, factor_data):
    factors, *_ = factor_data
    flat = factors.withColumn("rates_sensitivity", F.lit(0.25))
    got = rk.orthogonalise(flat).agg(F.min("rates_sensitivity"), F.max("rates_sensitivity")).first()
    assert np.allclose(tuple(got), 0.25)


def test_factor_regressions_recover_betas(spark, factor_data):
    factors, assets, f, y, betas = factor_data
    names = list(rk.FACTOR_ORDER)
    aligned = pit.lagged_factors(factors, assets, names)
    got = rk.factor_regressions(aligned).toPandas()
    by = {m: g.set_index("factor") for m, g in got.groupby("method")}
    assert np.allclose(by["ew_ols"].loc[names, "beta"].astype(float), betas, atol=0.35)
    assert by["ew_ols"]["significant"].any() and by["ew_ols"]["n_obs"].iloc[0] == 599
    x, target = f[:-1], y[1:]
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    ridge = np.linalg.solve(z.T @ z + np.eye(10), z.T @ (target - target.mean())) / x.std(0, ddof=1)
    assert np.allclose(by["ridge"].loc[names, "beta"].astype(float), ridge)
    assert np.allclose(by["tail_5"].loc[names, "beta"].astype(float), betas, atol=0.6)
    few = rk.factor_regressions(aligned.limit(50)).toPandas()
    assert set(few["status"]) == {"INSUFFICIENT_DATA"}


def residual_fixture(spark, seed=11):
    rng = np.random.default_rng(seed)
    common = rng.normal(0, 1, 300)
    x = np.column_stack([common + rng.normal(0, 0.2, 300) for _ in range(4)] + [rng.normal(0, 1, 300)])
    days = business_days(dt.date(2024, 6, 28), 300)
    rows = [(t, d, float(v)) for d, r in zip(days, x) for t, v in zip("ABCDE", r)]
    rows += [("F", days[0], None), ("G", days[5], 0.5), ("H", days[1], 1.0), ("H", days[2], -1.0)]
    groups = spark.createDataFrame([("g", t) for t in "ABCDEFG"] + [("h", t) for t in "ABH"], "group_id string, ticker string")
    return days, x, spark.createDataFrame(rows, "ticker string, effective_date date, residual double"), groups


def test_hidden_factor_is_found_and_noise_is_not(spark):
    _, _, rows, groups = residual_fixture(spark)
    got = {(r.group_id, r.component): r for r in rk.hidden_concentration(rows, groups, bootstraps=30).collect()}
    first = got["g", 0]
    assert first.members == list("ABCD") and first.stable and first.stability == 1.0
    assert first.message == "Hidden residual factor links 4 tickers (A, B, C, D). Stability 1.00 across 30 bootstraps."
    assert all(len(r.members) >= rk.MIN_CLUSTER for r in got.values()) and not any(r.stable for k, r in got.items() if k[1])
    assert rk.hidden_concentration(rows.limit(0), groups).count() == 0


def test_resamples_are_those_of_drawn_rows(spark):
    """Leading directions of every resample against numpy on the rows that were drawn, whatever the partitioning."""
    _, _, rows, groups = residual_fixture(spark)
    panel, names = rk.residual_panel(rows, groups)
    draws = rk.bootstrap_draws(panel, 8)
    found = {(r.group_id, r.replicate, r.component): r for r in rk.residual_components(rk.weighted_moments(panel.repartition(7), draws, 8)).collect()}
    names = {r.group_id: r.names for r in names.collect()}
    assert names == {"g": list("ABCDEG"), "h": list("ABH")}
    for g in names:
        held = sorted((r.effective_date, r.x, r.replicates) for r in panel.join(draws, ["group_id", "effective_date"], "left").where(F.col("group_id") == g).collect())
        for b in range(-1, 8):
            times = [1 if b < 0 else (picks or []).count(b) for _, _, picks in held]
            assert sum(times) == len(held) == 300
            x = np.repeat(np.array([x for _, x, _ in held]), times, axis=0)
            x = x - x.mean(axis=0)
            _, size, directions = np.linalg.svd(x, full_matrices=False)
            for c in range(min(3, x.shape[1])):
                r = found[g, b, c]
                assert r.members == np.flatnonzero(np.abs(directions[c]) >= rk.LOADING_CUTOFF).tolist()
                assert np.isclose(r.share, size[c] ** 2 / (size**2).sum()) and r.n_days == 300


def test_two_regimes_and_fallback(spark):
    rng = np.random.default_rng(2)
    days = business_days(dt.date(2012, 12, 31), 1500)
    panel = spark.createDataFrame([(d, list(map(float, rng.normal(0, 0.01, 3)))) for d in days], "effective_date date, x array<double>")
    cells = pf.two_regime_covariance(panel, 3).toPandas()
    methods = cells.groupby("regime")["method"].first().to_dict()
    assert methods == {"crisis": "mcd", "normal": "mcd"}
    calm = panel.where("effective_date > '2012-01-01'")
    cells = pf.two_regime_covariance(calm, 3, robust=False).toPandas().set_index(["regime", "i", "j"])["cov"]
    assert np.isclose(cells["crisis", 0, 0], 2 * cells["normal", 0, 0])
    for r in ("normal", "crisis"):
        m = cells[r].sort_index().to_numpy().reshape(3, 3)
        assert np.allclose(m, m.T) and np.all(np.linalg.eigvalsh(m) > 0)


def test_pairwise_correlation_with_gaps_matches_pandas(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(250, 4))
    x[:, 1] = x[:, 0] + 0.1 * rng.normal(size=250)
    x[::7, 2] = np.nan
    days = business_days(dt.date(2024, 6, 28), 250)
    rows = [(d, [None if np.isnan(v) else float(v) for v in r]) for d, r in zip(days, x)]
    panel = spark.createDataFrame(rows, "effective_date date, x array<double>").repartition(5)
    cells = mx.covariance_cells(mx.moment_matrices(panel.withColumn("k", F.lit("a")), 4, "k"), "k").toPandas()
    import pandas as pd
    want = pd.DataFrame(x).corr().to_numpy()
    got = cells.pivot(index="i", columns="j", values="corr").to_numpy()
    assert np.allclose(got, want)
    edges = pf.correlation_edges(panel, list("ABCD"))
    labels = {r.node: r.component for r in pf.connected_components(edges).collect()}
    assert labels == {"A": "A", "B": "A"}
    held = spark.createDataFrame([("A", 0.2), ("B", 0.3), ("C", 0.5)], "ticker string, weight double")
    c = pf.clusters(pf.connected_components(edges), held).first()
    assert c.members == ["A", "B"] and np.isclose(c.combined_weight, 0.5) and c.warning


def test_components_of_a_long_chain(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)] + [("z1", "z2")]
    edges = spark.createDataFrame(chain + [(b, a) for a, b in chain], "a string, b string")
    labels = {r.node: r.component for r in pf.connected_components(edges).collect()}
    assert {labels[f"n{i:02d}"] for i in range(41)} == {"n00"} and labels["z2"] == "z1"


def test_position_impact_rescales(spark):
    names = ["T0", "T1", "T2"]
    m = np.diag([0.04, 0.01, 0.02])
    cells = spark.createDataFrame([("normal", i, j, 10, float(m[i, j]), "x") for i in range(3) for j in range(3)], "regime string, i int, j int, n long, cov double, method string")
    weights = spark.createDataFrame([(1, "T0", 0.5), (1, "T1", 0.5)], "portfolio_id int, ticker string, weight double")
    wanted = spark.createDataFrame([(1, "T2", 0.2), (2, "T0", 0.3), (1, "XX", 0.1)], "portfolio_id int, ticker string, target_weight double")
    betas = spark.createDataFrame([("T2", "market_beta", 2.0, 3.0), ("T2", "usd", 1.0, 0.5)], "ticker string, factor string, beta double, t_stat double")
    got = {(r.portfolio_id, r.ticker): r for r in pf.position_impact(weights, wanted, cells, names, betas).collect()}
    w = np.array([0.4, 0.4, 0.2])
    assert np.isclose(got[1, "T2"].vol_after, np.sqrt(w @ m @ w)) and np.isclose(got[1, "T2"].eff_n_after, 1 / np.sum(w**2))
    assert got[1, "T2"].factor_additions == {"market_beta": 0.4}
    assert got[2, "T0"].vol_before == 0.0 and np.isclose(got[2, "T0"].vol_after, 0.3 * 0.2)
    assert got[1, "XX"].error == "XX not in universe"


def test_hmm_finds_two_regimes(spark):
    rng = np.random.default_rng(9)
    state = np.repeat([0, 1, 0, 1], 150)
    x = np.where(state[:, None] == 0, rng.normal(0.5, 0.3, (600, 2)), rng.normal(-1.0, 0.8, (600, 2)))
    days = business_days(dt.date(2024, 6, 28), 600)
    obs = spark.createDataFrame(
        [(s, d, *map(float, r)) for s in ("a", "b") for d, r in zip(days, x)], "series_id string, effective_date date, ret_21d double, realized_vol_21d double"
    )
    feats = ["ret_21d", "realized_vol_21d"]
    models = rg.fit_models(obs, feats, (2,)).persist()
    path = rg.decode(obs, models, feats).where("series_id = 'a'").orderBy("effective_date").toPandas()["state"].to_numpy()
    agree = np.mean(path == state)
    assert max(agree, 1 - agree) > 0.97
    assert models.agg(F.countDistinct("log_likelihood")).first()[0] == 1
    now = rg.current_state(obs, models, feats).first()
    assert np.isclose(sum(now.probs), 1) and now.state_uncertainty < 0.35 and not now.transition_signal
    pick = rg.select_k(rg.score_ks(obs, feats, (1, 2))).first()
    assert pick.selected_k == 2 and pick.n_train == 480
    labels = rg.label_states(rg.state_means(models, feats))
    report = rg.market_state_report(rg.decode(obs, models, feats), labels).first()
    assert abs(sum(s.prob for s in report.states) - 1) < 1e-9 and report.disclosure
    assert rg.dimensionality_adequacy(obs, feats).first()["passed"]


def test_likelihood_rises_with_every_round():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (100, 2)), rng.normal(4, 1, (100, 2))])
    ll = [hmm.fit(x, 2, max_iter=n, tol=-1)["ll"] for n in (2, 5, 10)]
    assert ll[0] <= ll[1] + 1e-6 <= ll[2] + 2e-6


def test_attribution_adds_up(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 3))
    rows = [(f"t{i}", dt.date(2024, 1, 8), dt.date(2024, 1, 8), *map(float, r), float(r[0] + 0.1 * rng.normal() > 0)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "ticker string, as_of date, vintage date, f0 double, f1 double, f2 double, y double")
    feats = ["f0", "f1", "f2"]
    model = at.train_classifier(df, feats, rounds=5)
    back = df.limit(40).select("vintage", *[F.col(f).alias(f"b_{f}") for f in feats])
    out = at.explain(model, df.limit(20), back, feats)
    got = out.toPandas()
    total = got[[f"phi_{f}" for f in feats]].sum(axis=1)
    assert np.allclose(total, got["score"] - got["base"])
    tops = at.top_contributions(out, feats).toPandas()["top_features"].map(lambda t: t[0])
    assert (tops == "f0").mean() > 0.8
    assert at.locked(df).first()["status"] == "LOCKED"
    fitted, scored, error = at.calibrate(at.probability(model, df))
    assert error.first()["ece"] < 0.05
    vintages = {r[0] for r in spark.createDataFrame([(dt.date(2024, 1, 8) + dt.timedelta(days=i),) for i in range(10)], "d date").select(at.background_vintage(F.col("d"))).collect()}
    assert len(vintages) in (2, 3)


def walked(nodes, x):
    """Sum of the trees at one row, node by node."""
    total = 0.0
    for tree in {n[0] for n in nodes}:
        at_ = {n[1]: n for n in nodes if n[0] == tree}
        n = at_[0]
        while n[2] >= 0:
            n = at_[n[2] if x[n[4]] <= n[5] else n[3]]
        total += n[6] * n[7]
    return total


def random_tree(rng, tree, depth, d):
    nodes, open_ = [], [(0, 0)]
    while open_:
        at_, level = open_.pop()
        if level == depth or (level and rng.random() < 0.2):
            nodes.append((tree, at_, -1, -1, None, None, float(rng.normal()), 0.5 + tree))
        else:
            nodes.append((tree, at_, 2 * at_ + 1, 2 * at_ + 2, int(rng.integers(0, d)), float(rng.normal(0, 0.5)), 0.0, 0.5 + tree))
            open_ += [(2 * at_ + 1, level + 1), (2 * at_ + 2, level + 1)]
    return nodes


@pytest.mark.parametrize("d", [1, 4, 9])
def test_contributions_along_paths_are_those_of_all_coalitions(spark, d):
    """Random trees whose paths ask for a feature more than once; two vintages, one without rows, one of a single day."""
    rng = np.random.default_rng(d)
    nodes = [n for t in range(3) for n in random_tree(rng, t, 4, d)]
    feats = [f"f{i}" for i in range(d)]
    x, back = rng.normal(size=(6, d)).round(1), rng.normal(size=(12, d)).round(1)
    v1, v2 = dt.date(2024, 1, 8), dt.date(2024, 1, 13)
    rows = spark.createDataFrame([(f"t{i}", v1, v1, *map(float, r)) for i, r in enumerate(x)] + [("u", v2, v2, *map(float, x[0]))],
                                 "ticker string, as_of date, vintage date, " + ", ".join(f"{f} double" for f in feats))
    backs = spark.createDataFrame([(v1, *map(float, r)) for r in back] + [(v2, *map(float, back[0])), (dt.date(2024, 2, 1), *map(float, back[1]))],
                                  "vintage date, " + ", ".join(f"b_{f} double" for f in feats))
    got = {r.ticker: r for r in at.explain_trees(spark.createDataFrame(nodes, at.NODES), rows, backs, feats).collect()}
    assert len(got) == 7
    for ticker, row, held in [*((f"t{i}", r, back) for i, r in enumerate(x)), ("u", x[0], back[:1])]:
        value = {
            s: np.mean([walked(nodes, [row[i] if s >> i & 1 else z[i] for i in range(d)]) for z in held]) for s in range(1 << d)
        }
        for i, f in enumerate(feats):
            want = sum(
                math.factorial(s.bit_count()) * math.factorial(d - s.bit_count() - 1) / math.factorial(d) * (value[s | 1 << i] - value[s])
                for s in range(1 << d) if not s >> i & 1
            )
            assert math.isclose(got[ticker][f"phi_{f}"], want, abs_tol=1e-9)
        assert math.isclose(got[ticker].base, value[0], abs_tol=1e-9) and math.isclose(got[ticker].score, value[(1 << d) - 1], abs_tol=1e-9)


def test_a_fitted_ensemble_with_many_features(spark):
    """Thirty features: contributions add up to the model's own margin less that of the background."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 30))
    feats = [f"f{i}" for i in range(30)]
    day = dt.date(2024, 1, 8)
    rows = [(f"t{i}", day, day, *map(float, r), float(r[0] + r[7] > 0)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "ticker string, as_of date, vintage date, " + ", ".join(f"{f} double" for f in feats) + ", y double")
    model = at.train_classifier(df, feats, rounds=6)
    back = df.limit(50).select("vintage", *[F.col(f).alias(f"b_{f}") for f in feats])
    nodes = at.tree_nodes(spark, model.stages[-1])
    out = at.explain_trees(nodes, df.limit(20), back, feats).toPandas().set_index("ticker")
    margin = {r.ticker: float(r.rawPrediction[1]) for r in model.transform(df).collect()}
    assert np.allclose(out["score"], [margin[t] for t in out.index])
    assert np.allclose(out[[f"phi_{f}" for f in feats]].sum(axis=1), out["score"] - out["base"])
    tops = at.top_contributions(at.explain_trees(nodes, df.limit(20), back, feats), feats).toPandas()["top_features"]
    assert (tops.map(lambda t: t[0]).isin(["f0", "f7"])).mean() > 0.8


def test_background_is_the_last_trading_days(spark):
    days = business_days(dt.date(2024, 6, 28), 300)
    history = spark.createDataFrame([(d, float(k)) for k, d in enumerate(days)], "effective_date date, f double")
    asked = [days[-1], days[100] + dt.timedelta(days=0), dt.date(2024, 6, 23), dt.date(2000, 1, 1)]
    vintages = spark.createDataFrame([(d,) for d in asked], "vintage date")
    got = {}
    for r in at.background(history, vintages, ["f"]).collect():
        got.setdefault(r.vintage, []).append(r.b_f)
    last = {d: max((k for k, e in enumerate(days) if e <= d), default=None) for d in asked}
    assert {d: sorted(v) for d, v in got.items()} == {
        d: [float(k) for k in range(max(0, n - 251), n + 1)] for d, n in last.items() if n is not None
    }


def test_forecast_is_reproducible_and_ordered(spark):
    rng = np.random.default_rng(8)
    days = business_days(dt.date(2024, 6, 28), 600)
    rows = spark.createDataFrame([("A", d, float(r)) for d, r in zip(days, rng.normal(0, 0.01, 600))] + [("S", d, 0.01) for d in days[:9]], "ticker string, effective_date date, ret_1d double")
    sims = fc.simulate(fc.return_history(rows))
    got = fc.bands(sims).orderBy("h").collect()
    assert {r.ticker for r in got} == {"A"} and [r.h for r in got] == [1, 3, 5, 10]
    assert all(r.p5 <= r.p50 <= r.p95 and 0 <= r.p_up <= 1 for r in got)
    widths = [r.p95 - r.p5 for r in got]
    assert widths == sorted(widths)
    assert [tuple(r) for r in fc.bands(sims.repartition(7)).orderBy("h").collect()] == [tuple(r) for r in got]


def test_many_robust_fits_are_those_of_one(spark):
    rng = np.random.default_rng(8)
    for x in (
        rng.standard_t(3, (330, 4)) * [1, 5, 20, 0.1], np.round(rng.normal(size=(300, 3))), np.repeat(rng.normal(size=(50, 3)), 6, axis=0),
        np.column_stack([rng.normal(size=(240, 2)), np.ones(240)]),
    ):
        ends = np.arange(10, len(x) + 1, 23)
        for end, (cov, method, kept) in zip(ends, linalg.robust_fits(x, ends)):
            want = linalg.robust_fit(x[:end])
            assert (method, kept) == want[1:] and np.allclose(cov, want[0], rtol=1e-9, atol=1e-12)


def test_search_sends_only_the_nearest_rows_on(spark, analog_rows):
    """Rows and queries of a ticker meet in one task: no pairs are joined, and nothing is sorted by query."""
    rows, *_ = analog_rows
    plain = rows.sparkSession.createDataFrame(rows.rdd, rows.schema)
    found = an.find_analogs(plain, an.fit_robust_precision(plain, plain.where("row_no > 740")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    more = an.find_analogs(plain, an.fit_robust_precision(plain, plain.where("row_no > 700")))
    assert found.count() == 60 * 30 and more.count() == 100 * 30
    assert found.exceptAll(more).isEmpty()


def test_queries_of_one_date_answer_as_one(spark, analog_rows):
    rows, *_ = analog_rows
    q = an.fit_robust_precision(rows, rows.where("row_no IN (600, 700)")).withColumn("effective_date", F.lit("2024-12-31").cast("date"))
    got = an.find_analogs(rows, q).orderBy("rank").collect()
    each = an.find_analogs(rows, an.fit_robust_precision(rows, rows.where("row_no IN (600, 700)"))).collect()
    assert [r["rank"] for r in got] == list(range(1, 31))
    assert np.allclose([r.distance for r in got], sorted(r.distance for r in each)[:30])


def test_wide_groups_go_by_their_days(spark, monkeypatch):
    """A group of more names than the limit has the components that the products of its names give."""
    _, _, rows, groups = residual_fixture(spark)
    panel, names = rk.residual_panel(rows, groups)
    draws = rk.bootstrap_draws(panel, 8)
    want = {(r.group_id, r.replicate, r.component): r for r in rk.residual_components(rk.weighted_moments(panel, draws, 8)).collect()}
    monkeypatch.setattr(rk, "weighted_moments", lambda p, *a: _narrow_only(p, *a))
    monkeypatch.setattr(rk, "MOST_NAMES", 4)
    got = {(r.group_id, r.replicate, r.component): r for r in rk.bootstrap_components(panel, names, draws, 3, 8).collect()}
    assert got.keys() == want.keys() and {k[0] for k in got} == {"g", "h"}
    for k, r in want.items():
        assert np.isclose(got[k].share, r.share, atol=1e-12) and got[k].n_days == r.n_days
        if r.share > 1e-9:
            assert got[k].members == r.members


_narrow = rk.weighted_moments


def _narrow_only(panel, *args):
    assert panel.where("size(x) > 4").isEmpty()
    return _narrow(panel, *args)


@pytest.mark.parametrize("most", [65_536, 20])
def test_percentiles_of_stored_rows(spark, tmp_path, most):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.standard_t(2, 3000), np.full(2000, 0.5), [1e300, -1e300]])
    spark.createDataFrame([("a", float(v)) for v in values] + [(None, 1.0), ("b", None)], "k string, v double").write.parquet(f"{tmp_path}/v")
    probs = {"p5": 0.05, "p50": 0.5, "p97": 0.97}
    got = {r.k: r for r in exact_percentiles(spark.read.parquet(f"{tmp_path}/v"), ["k"], "v", probs, most, stored=True).collect()}
    assert got.keys() == {"a", None} and got[None].p50 == 1.0
    for name, p in probs.items():
        assert np.isclose(got["a"][name], np.quantile(values, p), rtol=1e-12)


def test_rows_of_one_date_are_numbered_by_ties(spark):
    rows = spark.createDataFrame(
        [("T", dt.date(2024, 1, 2 + k // 2), *[float(k)] * len(FEATS), None, k) for k in range(6)],
        "ticker string, effective_date date, " + ", ".join(f"{f} double" for f in FEATS) + ", ret_fwd_10d double, _at int",
    )
    got = an.numbered(rows.repartition(3), ties="_at")
    assert "_at" not in got.columns
    assert [r.ret_1d for r in got.orderBy("row_no").collect()] == [1, 0, 3, 2, 5, 4]


def test_quantile_fits_side_by_side_are_those_alone(monkeypatch):
    """Fits of several widths and lengths, a rank too few, and some that do not settle."""
    rng = np.random.default_rng(5)
    problems = []
    for k, n in enumerate((90, 120, 81, 200, 95, 110, 130)):
        x = rng.normal(0, 0.3, (n, 4 if k % 3 else 2))
        if k == 4:
            x[:, 1] = x[:, 0]
        problems.append((x, x @ rng.normal(0, 1, x.shape[1]) + rng.standard_t(3, n), 0.05 if k % 2 else 0.95))
    monkeypatch.setattr(rk, "FITS_AT_ONCE", 3)
    alone = [rk.quantile_regression(*p) for p in problems]
    for one, other in zip(alone, rk.quantile_regressions(problems)):
        np.testing.assert_allclose(one, other, atol=2e-6)
    unsettled = [rk.quantile_regression(*p, steps=5) for p in problems]
    assert all((a == b).all() for a, b in zip(unsettled, rk.quantile_regressions(problems, steps=5)))
    assert rk.quantile_regressions([]) == []


def test_factor_regressions_of_tickers_that_stream_by(spark, factor_data, monkeypatch):
    """Groups cut by batches, one without a name, one with too few rows: every row as the fits of each ticker alone."""
    *_, f, y, _ = factor_data
    days = [dt.date(2022, 1, 3) + dt.timedelta(days=k) for k in range(600)]
    names, rng, rows = list(rk.FACTOR_ORDER), np.random.default_rng(2), []
    held = {"A": 600, "B": 150, None: 200, "C": 40, "D": 90}
    data = {t: (f[:n], y[:n] + rng.normal(0, 0.01, n)) for t, n in held.items()}
    for t, (x, r) in data.items():
        rows += [(t, d, float(v), *map(float, xi)) for d, v, xi in zip(days, r, x)]
    rng.shuffle(rows)
    aligned = spark.createDataFrame([tuple(r) for r in rows], "ticker string, effective_date date, asset_ret double, " + ", ".join(f"{n} double" for n in names))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        found = rk.factor_regressions(aligned)
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(r.ticker, r.method, r.factor): r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 4 * 4 * 10 + 4
    for t, (x, r) in data.items():
        for method in ("ew_ols", "ridge", "tail_5", "tail_95"):
            n = len(r) if "_" not in method or method == "ew_ols" else min(len(r), rk.TAIL_LOOKBACK_DAYS + 31)
            if n < rk.MIN_OBS:
                one = got[t, method, None]
                assert (one.status, one.n_obs, one.beta, one.significant) == ("INSUFFICIENT_DATA", n, None, False)
                continue
            if method == "ew_ols":
                beta, t_stat, r2, idio = rk.weighted_ols(x, r, rk.DECAY_SHORT)
                beta = beta[1:]
            elif method == "ridge":
                (beta, r2, idio), t_stat = rk.ridge(x, r, 1.0), None
            else:
                beta, t_stat, r2, idio = rk.quantile_regression(x[-n:], r[-n:], int(method[5:]) / 100)[1:], None, None, None
            mine = [got[t, method, k] for k in names]
            np.testing.assert_allclose([m.beta for m in mine], beta, atol=2e-6)
            assert all((m.n_obs, m.status, m.r_squared, m.idiosyncratic_pct) == (n, "OK", r2, idio) for m in mine)
            if t_stat is not None:
                np.testing.assert_allclose([m.t_stat for m in mine], t_stat[1:])
                assert [m.significant for m in mine] == [abs(v) >= rk.SIGNIFICANT_T for v in t_stat[1:]]
            else:
                assert all(m.t_stat is None and m.significant is False for m in mine)


def test_closing_rows_are_those_of_the_bars(spark, tmp_path):
    """Without stored bars only the columns of closing() are written; both entities have the bars' rows."""
    from plumbline import session
    from plumbline.sources import tables as tb
    from tests.test_pit_and_store import _supplier_tables

    _supplier_tables(spark, tmp_path)
    kept, d, before = ["ticker", "effective_date", "close", "volume"], str(tmp_path), set(session._STORED)
    got = {e: sorted(tb.closing(spark, d, e).select(*kept).collect()) for e in ("supplier", "region")}
    assert [k[1] for k in set(session._STORED) - before] == ["daily-closing"]
    for entity, rows in got.items():
        assert rows and rows == sorted(tb.bars(spark, d, entity).select(*kept).collect())
        assert rows == sorted(tb.closing(spark, d, entity).select(*kept).collect())  # from the stored bars
