"""Factor, covariance and portfolio plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import features as ft
from plumbline.operators import matrix as mx
from plumbline.operators import portfolio as pf
from plumbline.operators import risk as rk
from plumbline.plans.analog_plans import robust_parts, sweep_parts
from plumbline.plans.feature_plans import W
from plumbline.plans.registry import plan
from plumbline.plans.sqlparts import part, with_parts
from plumbline.plans.store_plans import FACTORS, REGIONS, aligned, factors
from plumbline.session import materialise
from plumbline.sources import tables as tb

D = len(REGIONS)
# The supplied calendar ends before the fixed crisis windows begin, so these plans
# name stressed ranges of their own; the operator's default stays the fixed list.
WINDOWS = (("1998-08-01", "1998-10-31"), ("2000-03-10", "2001-04-04"))
_CRISIS = " OR ".join(f"effective_date BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in WINDOWS)

# ---- orthogonal factors: residuals are orthogonal, so each slope stands alone
_prev = "ortho0"
part("ortho0", "factors", f"SELECT effective_date, {FACTORS[0]} AS r0, {', '.join(FACTORS)} FROM factors WHERE {' AND '.join(f + ' IS NOT NULL' for f in FACTORS)}")
for _i in range(1, len(FACTORS)):
    _fit = " - ".join(
        [f"{FACTORS[_i]} - avg({FACTORS[_i]}) OVER ()"]
        + [f"(covar_pop({FACTORS[_i]}, r{j}) OVER () / var_pop(r{j}) OVER ()) * (r{j} - avg(r{j}) OVER ())" for j in range(_i)])
    part(f"ortho{_i}", _prev, f"SELECT *, {_fit} AS r{_i} FROM {_prev}")
    _prev = f"ortho{_i}"


@plan("orthogonal_factors", "effective_date:d " + " ".join(f"{f}:f" for f in FACTORS), "M15",
      with_parts(_prev, f"SELECT effective_date, {', '.join(f'r{i} AS {f}' for i, f in enumerate(FACTORS))} FROM {_prev}"))
def _(spark, sf_dir):
    return rk.orthogonalise(factors(spark, sf_dir).dropna())


@plan("factor_regressions", "ticker:s method:s factor:s beta:f t_stat:f significant:b r_squared:f idiosyncratic_pct:f n_obs:i status:s", "M16 M17 M18")
def _(spark, sf_dir):
    return rk.factor_regressions(aligned(spark, sf_dir))


# ---- the linear ones by normal equations of centred sums
_K = len(FACTORS)
_CELLS = [(i, j) for i in range(_K) for j in range(i, _K)]


def _a(i: int, j: int) -> str:
    return f"a{min(i, j)}_{max(i, j)}"


part("reg_rows", "aligned", f"""
SELECT ticker, asset_ret AS y, {', '.join(f'{f} AS x{i}' for i, f in enumerate(FACTORS))}, count(*) OVER (PARTITION BY ticker) AS n,
 pow(CAST({rk.DECAY_SHORT} AS DOUBLE), count(*) OVER (PARTITION BY ticker) - row_number() OVER (PARTITION BY ticker ORDER BY effective_date)) AS w FROM aligned""")
part("ols_mean", "reg_rows", f"""
SELECT ticker, any_value(n) AS n, sum(w * y) / sum(w) AS my, {', '.join(f'sum(w * x{i}) / sum(w) AS m{i}' for i in range(_K))} FROM reg_rows GROUP BY 1 HAVING any_value(n) >= {rk.MIN_OBS}""")
part("ridge_mean", "reg_rows", f"""
SELECT ticker, any_value(n) AS n, avg(y) AS my, {', '.join(f'avg(x{i}) AS m{i}, CASE WHEN stddev_samp(x{i}) > 0 THEN stddev_samp(x{i}) ELSE 1 END AS s{i}' for i in range(_K))} FROM reg_rows GROUP BY 1 HAVING any_value(n) >= {rk.MIN_OBS}""")
_SOLVED = {}
for _m, _z, _w, _ridge in (("ols", "(x{0} - m{0})", "w", 0), ("ridge", "((x{0} - m{0}) / s{0})", "1", 1)):
    _sums = ", ".join(
        f"sum({_w} * {_z.format(i)} * {_z.format(j)})" + (f" + {_ridge}" if i == j and _ridge else "") + f" AS a{i}_{j}" for i, j in _CELLS)
    part(f"{_m}_sums", f"reg_rows {_m}_mean", f"""
SELECT ticker, any_value(r.n) AS n, sum({_w} * pow(y - my, 2)) AS yy, var_samp(y) AS vy, {', '.join(f'sum({_w} * {_z.format(i)} * (y - my)) AS c{i}' for i in range(_K))}, {_sums}
FROM reg_rows r JOIN {_m}_mean USING (ticker) GROUP BY 1""")
    _inv = sweep_parts(f"{_m}_inv", f"{_m}_sums", "ticker", _K)
    _beta = ", ".join("-(" + " + ".join(f"v.{_a(i, j)} * c{j}" for j in range(_K)) + f") AS b{i}" for i in range(_K))
    part(f"{_m}_beta", f"{_m}_sums {_inv}", f"""
SELECT ticker, n, yy, vy, {', '.join(f'c{i}' for i in range(_K))}, {', '.join(f'-v.a{i}_{i} AS v{i}' for i in range(_K))}, {_beta} FROM {_m}_sums s JOIN {_inv} v USING (ticker)""")
part("ols_resid", "reg_rows ols_beta", f"SELECT ticker, var_samp(y - ({' + '.join(f'x{i} * b{i}' for i in range(_K))})) AS vr FROM reg_rows JOIN ols_beta USING (ticker) GROUP BY 1")
_EXPLAINED = " + ".join(f"b{i} * c{i}" for i in range(_K))
_SHRUNK = " + ".join(f"b{i} * b{i}" for i in range(_K))


def _ols_row(i: int) -> str:
    t = f"b{i} / sqrt(v{i} * (yy - ({_EXPLAINED})) / (n - {_K + 1}))"
    return (f"SELECT ticker, 'ew_ols' AS method, '{FACTORS[i]}' AS factor, b{i} AS beta, {t} AS t_stat, abs({t}) >= {rk.SIGNIFICANT_T} AS significant, "
            f"({_EXPLAINED}) / yy AS r_squared, CASE WHEN vy > 0 THEN vr / vy ELSE 1 END AS idiosyncratic_pct, n AS n_obs, 'OK' AS status FROM ols_beta JOIN ols_resid USING (ticker)")


def _ridge_row(i: int) -> str:
    share = f"(yy - ({_EXPLAINED}) - ({_SHRUNK})) / yy"
    return (f"SELECT ticker, 'ridge', '{FACTORS[i]}', b{i} / s{i}, NULL, false, 1 - {share}, {share}, ridge_beta.n, 'OK' FROM ridge_beta JOIN ridge_mean USING (ticker)")


@plan("factor_regressions_linear", "ticker:s method:s factor:s beta:f4 t_stat:f4 significant:b r_squared:f idiosyncratic_pct:f n_obs:i status:s", "M16 M17",
      with_parts("ols_resid ridge_beta reg_rows", " UNION ALL ".join(
          [_ols_row(i) for i in range(_K)] + [_ridge_row(i) for i in range(_K)] + [
              f"SELECT DISTINCT ticker, m.m, CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), false, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), n, 'INSUFFICIENT_DATA' FROM reg_rows, (VALUES ('ew_ols'), ('ridge')) AS m(m) WHERE n < {rk.MIN_OBS}"])))
def _(spark, sf_dir):
    return rk.factor_regressions(aligned(spark, sf_dir), methods=("ew_ols", "ridge"))


# ---- clusters in the residuals of a nation's tickers
part("resid", "aligned ols_beta", f"""
SELECT ticker, effective_date, asset_ret - ({' + '.join(f'{f} * b{i}' for i, f in enumerate(FACTORS))}) AS r FROM aligned JOIN ols_beta USING (ticker)""")
part("res_rows", "resid", f"""
SELECT n_name AS g, ticker, effective_date, r FROM resid JOIN supplier ON s_name = ticker JOIN nation ON s_nationkey = n_nationkey
QUALIFY count(DISTINCT ticker) OVER (PARTITION BY n_name) >= {rk.MIN_CLUSTER}""")
part("res_days", "res_rows", """
SELECT g, effective_date, row_number() OVER (PARTITION BY g ORDER BY effective_date) - 1 AS k, count(*) OVER (PARTITION BY g) AS n
FROM (SELECT DISTINCT g, effective_date FROM res_rows)""")
part("res_draws", "res_days", f"""
SELECT g, b, d.effective_date, w FROM (
 SELECT g, b, CAST('0x' || substr(md5(g || '|' || b || '|' || k), 1, 8) AS BIGINT) % n AS k, count(*) AS w FROM res_days, range({rk.BOOTSTRAPS}) AS t(b) GROUP BY 1, 2, 3)
JOIN res_days d USING (g, k) UNION ALL SELECT g, -1, effective_date, 1 FROM res_days""")
part("res_sums", "res_rows res_draws", "SELECT g, b, ticker, sum(w * r) AS s FROM res_rows JOIN res_draws USING (g, effective_date) GROUP BY 1, 2, 3")
part("res_products", "res_rows res_draws", """
SELECT g, b, i, j, sum(w * v) AS v FROM (
 SELECT x.g, x.effective_date, x.ticker AS i, y.ticker AS j, x.r * y.r AS v FROM res_rows x JOIN res_rows y USING (g, effective_date)) JOIN res_draws USING (g, effective_date) GROUP BY 1, 2, 3, 4""")
# All pairs of names, met on a day or not; a name that is not drawn has moments of zero.
part("res_m0", "res_products res_sums res_days res_rows", f"""
SELECT c.g, c.b, c.i, c.j, coalesce(v, 0) - coalesce(x.s, 0) * coalesce(y.s, 0) / n AS v FROM (
 SELECT a.g, b, a.ticker AS i, z.ticker AS j, n FROM (SELECT DISTINCT g, ticker FROM res_rows) a JOIN (SELECT DISTINCT g, ticker FROM res_rows) z USING (g)
 JOIN (SELECT DISTINCT g, n FROM res_days) USING (g), range(-1, {rk.BOOTSTRAPS}) AS t(b)) c
LEFT JOIN res_products USING (g, b, i, j) LEFT JOIN res_sums x ON x.g = c.g AND x.b = c.b AND x.ticker = c.i LEFT JOIN res_sums y ON y.g = c.g AND y.b = c.b AND y.ticker = c.j""")
# Leading directions: the matrix squared over and over turns into its first direction, which is then taken out.
_SQUARINGS = 24
for _c in range(3):
    part(f"res_p{_c}_0", f"res_m{_c}", f"SELECT g, b, i, j, v / sum(v) FILTER (WHERE i = j) OVER (PARTITION BY g, b) AS v FROM res_m{_c}")
    for _s in range(_SQUARINGS):
        part(f"res_p{_c}_{_s + 1}", f"res_p{_c}_{_s}", f"""
SELECT g, b, i, j, v / sum(v) FILTER (WHERE i = j) OVER (PARTITION BY g, b) AS v FROM (
 SELECT x.g, x.b, x.i, y.j, sum(x.v * y.v) AS v FROM res_p{_c}_{_s} x JOIN res_p{_c}_{_s} y ON x.g = y.g AND x.b = y.b AND x.j = y.i GROUP BY 1, 2, 3, 4)""")
    part(f"res_v{_c}", f"res_p{_c}_{_SQUARINGS}", f"""
SELECT g, b, i, v / sqrt(sum(v * v) OVER (PARTITION BY g, b)) AS u FROM res_p{_c}_{_SQUARINGS}
JOIN (SELECT g, b, arg_max(i, v) AS j FROM res_p{_c}_{_SQUARINGS} WHERE i = j GROUP BY 1, 2) USING (g, b, j)""")
    part(f"res_l{_c}", f"res_m{_c} res_v{_c}", f"""
SELECT g, b, sum(x.u * m.v * y.u) AS l FROM res_m{_c} m JOIN res_v{_c} x USING (g, b, i) JOIN (SELECT g, b, i AS j, u FROM res_v{_c}) y USING (g, b, j) GROUP BY 1, 2""")
    part(f"res_m{_c + 1}", f"res_m{_c} res_v{_c} res_l{_c}", f"""
SELECT g, b, i, j, m.v - l * x.u * y.u AS v FROM res_m{_c} m JOIN res_v{_c} x USING (g, b, i) JOIN (SELECT g, b, i AS j, u FROM res_v{_c}) y USING (g, b, j) JOIN res_l{_c} USING (g, b)""")
part("res_found", "res_m0 " + " ".join(f"res_v{c} res_l{c}" for c in range(3)), " UNION ALL ".join(f"""
SELECT g, b, {c} AS component, any_value(l) / any_value(t) AS share, coalesce(list(i ORDER BY i) FILTER (WHERE abs(u) >= {rk.LOADING_CUTOFF}), []) AS members
FROM res_v{c} JOIN res_l{c} USING (g, b) JOIN (SELECT g, b, sum(v) AS t FROM res_m0 WHERE i = j GROUP BY 1, 2) USING (g, b) GROUP BY 1, 2""" for c in range(3)))
_BASE = f"SELECT g, component, members FROM res_found WHERE b = -1 AND len(members) >= {rk.MIN_CLUSTER}"


def nation_residuals(spark, sf_dir):
    """What the factors leave of each ticker's returns, and which nation it belongs to."""
    rows = aligned(spark, sf_dir)
    left = rk.residuals(rows, rk.factor_regressions(rows, methods=("ew_ols",)))
    nations = tb.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("group_id"))
    return left, tb.read(spark, sf_dir, "supplier").join(nations, "s_nationkey").select("group_id", F.col("s_name").alias("ticker"))


@plan("residual_components", "group_id:s replicate:i component:i share:f members:s", "M19",
      with_parts("res_found", "SELECT g AS group_id, b AS replicate, component, share, array_to_string(members, '|') AS members FROM res_found"))
def _(spark, sf_dir):
    panel, names = rk.residual_panel(*nation_residuals(spark, sf_dir))
    found = rk.bootstrap_components(panel, names, rk.bootstrap_draws(panel))
    return found.join(names, "group_id").withColumn("members", F.array_join(F.transform("members", lambda k: F.col("names")[k]), "|"))


@plan("hidden_concentration", "group_id:s component:i members:s n_members:i stability:f stable:b poorly_conditioned:b message:s", "M19 U4",
      with_parts("res_found res_days res_rows", f"""
, base AS ({_BASE}),
hits AS (SELECT g, component, count(DISTINCT b) / {rk.BOOTSTRAPS}.0 AS stability FROM base JOIN (SELECT g, b, members AS cluster FROM res_found WHERE b >= 0 AND len(members) >= {rk.MIN_CLUSTER}) USING (g)
 WHERE len(list_intersect(members, cluster)) / (len(members) + len(cluster) - len(list_intersect(members, cluster))) >= {rk.JACCARD_MATCH} GROUP BY 1, 2)
SELECT g AS group_id, component, array_to_string(members, '|') AS members, len(members) AS n_members, coalesce(stability, 0) AS stability, coalesce(stability, 0) >= {rk.STABILITY} AS stable, n < 5 * d AS poorly_conditioned,
 'Hidden residual factor links ' || len(members) || ' tickers (' || array_to_string(members, ', ') || '). Stability ' || printf('%.2f', coalesce(stability, 0)) || ' across {rk.BOOTSTRAPS} bootstraps.' AS message
FROM base LEFT JOIN hits USING (g, component) JOIN (SELECT DISTINCT g, n FROM res_days) USING (g) JOIN (SELECT g, count(DISTINCT ticker) AS d FROM res_rows GROUP BY 1) USING (g)"""))
def _(spark, sf_dir):
    return rk.hidden_concentration(*nation_residuals(spark, sf_dir)).withColumn("members", F.array_join("members", "|"))


# ---- covariance of region returns
part("region_panel", "feat_region", f"""
SELECT effective_date, {', '.join(f"max(ret_1d) FILTER (WHERE ticker = '{r}') AS x{i}" for i, r in enumerate(REGIONS))},
 CASE WHEN {_CRISIS} THEN 'crisis' ELSE 'normal' END AS regime FROM feat_region GROUP BY effective_date""")
part("complete_panel", "region_panel", f"SELECT * FROM region_panel WHERE {' AND '.join(f'x{i} IS NOT NULL' for i in range(D))}")
part("regime_cells", "complete_panel", " UNION ALL ".join(
    f"SELECT regime, {i} AS i, {j} AS j, count(*) AS n, covar_samp(x{i}, x{j}) AS cov FROM complete_panel GROUP BY 1 HAVING count(*) >= 2"
    for i in range(D) for j in range(D)))
part("regime_cov", "regime_cells", """
SELECT *, 'sample' AS method FROM regime_cells UNION ALL SELECT 'crisis', i, j, 0, 2 * cov, 'normal_x2' FROM regime_cells
WHERE regime = 'normal' AND NOT EXISTS (SELECT 1 FROM regime_cells WHERE regime = 'crisis')""")


def region_panel(spark, sf_dir):
    rets = ft.add_returns(tb.bars(spark, sf_dir, "region"), (1,)).select("ticker", "effective_date", F.col("ret_1d").alias("ret")).dropna()
    return mx.panel(rets, list(REGIONS))


def sample_cells(spark, sf_dir):
    return pf.two_regime_covariance(region_panel(spark, sf_dir), D, WINDOWS, robust=False)


@plan("two_regime_covariance", "regime:s i:i j:i n:i cov:f method:s", "M23 P10",
      with_parts("regime_cov", "SELECT * FROM regime_cov"))
def _(spark, sf_dir):
    return sample_cells(spark, sf_dir)


@plan("two_regime_covariance_default_windows", "regime:s i:i j:i n:i cov:f method:s", "M23 P10",
      with_parts("complete_panel", " UNION ALL ".join(
          f"SELECT 'normal' AS regime, {i} AS i, {j} AS j, count(*) AS n, covar_samp(x{i}, x{j}) AS cov, 'sample' AS method FROM complete_panel"
          f" UNION ALL SELECT 'crisis', {i}, {j}, 0, 2 * covar_samp(x{i}, x{j}), 'normal_x2' FROM complete_panel" for i in range(D) for j in range(D))))
def _(spark, sf_dir):
    return pf.two_regime_covariance(region_panel(spark, sf_dir), D, robust=False)


_NAMES = [f"x{i}" for i in range(D)]
_ROBUST = robust_parts("reg", "complete_panel", ("regime",), _NAMES, pf.MIN_ROWS_PER_NAME * D, "effective_date")


_UPPER = [(i, j) for i in range(D) for j in range(i, D)]
_NORM = " + ".join(f"pow({x} - m{i}, 2)" for i, x in enumerate(_NAMES))
part("reg_mean", "complete_panel", f"SELECT regime, count(*) AS n, {', '.join(f'avg({x}) AS m{i}' for i, x in enumerate(_NAMES))} FROM complete_panel GROUP BY 1")
part("reg_plain", "complete_panel reg_mean", f"""
SELECT regime, any_value(n) AS n, {', '.join(f'avg((x{i} - m{i}) * (x{j} - m{j})) AS e{i}_{j}' for i, j in _UPPER)}, sum(pow({_NORM}, 2)) AS norm4
FROM complete_panel JOIN reg_mean USING (regime) GROUP BY 1""")
part("reg_weight", "reg_plain", f"""
SELECT *, CASE WHEN delta > 0 THEN least((norm4 / n - sq) / ({D} * n), delta) / delta ELSE 0 END AS w FROM (
 SELECT *, (sq - {D} * mu * mu) / {D} AS delta FROM (
  SELECT *, ({' + '.join(f'e{i}_{i}' for i in range(D))}) / {D} AS mu, {' + '.join(('' if i == j else '2 * ') + f'e{i}_{j} * e{i}_{j}' for i, j in _UPPER)} AS sq FROM reg_plain))""")
_CELLS_OF = " UNION ALL ".join(
    f"SELECT regime, {i} AS i, {j} AS j, n, {{cell}} AS cov, '{{method}}' AS method FROM {{source}}".replace("{cell}", f"{{cell{min(i, j)}{max(i, j)}}}")
    for i in range(D) for j in range(D))
part("reg_robust_cells", _ROBUST, _CELLS_OF.format(source=_ROBUST, method="mcd", **{f"cell{i}{j}": f"c{i}_{j}" for i, j in _UPPER}))
part("reg_shrunk_cells", "reg_weight", _CELLS_OF.format(
    source="reg_weight", method="ledoit_wolf", **{f"cell{i}{j}": f"(1 - w) * e{i}_{j}" + (" + w * mu" if i == j else "") for i, j in _UPPER}))


@plan("two_regime_covariance_robust", "regime:s i:i j:i n:i cov:f9 method:s", "M23 M8",
      with_parts("reg_robust_cells reg_shrunk_cells regime_cells", f"""
, calm AS (SELECT * FROM reg_robust_cells WHERE regime = 'normal' UNION ALL
 SELECT * FROM reg_shrunk_cells WHERE regime = 'normal' AND NOT EXISTS (SELECT 1 FROM reg_robust_cells WHERE regime = 'normal'))
SELECT * FROM calm UNION ALL SELECT * FROM reg_robust_cells WHERE regime = 'crisis'
UNION ALL SELECT regime, i, j, n, cov, 'sample' FROM regime_cells WHERE regime = 'crisis' AND n < {pf.MIN_ROWS_PER_NAME * D}
UNION ALL SELECT 'crisis', i, j, 0, 2 * cov, 'normal_x2' FROM calm WHERE NOT EXISTS (SELECT 1 FROM regime_cells WHERE regime = 'crisis')"""))
def _(spark, sf_dir):
    return pf.two_regime_covariance(region_panel(spark, sf_dir), D, WINDOWS)


@plan("crisis_days", "effective_date:d regime:s", "P10", with_parts("region_panel", "SELECT effective_date, regime FROM region_panel WHERE x0 IS NOT NULL OR x1 IS NOT NULL OR x2 IS NOT NULL OR x3 IS NOT NULL OR x4 IS NOT NULL"))
def _(spark, sf_dir):
    return pf.regime_rows(region_panel(spark, sf_dir), WINDOWS)


# ---- portfolios: each customer's spend by region
part("weights", "", """
SELECT portfolio_id, ticker, spend / sum(spend) OVER (PARTITION BY portfolio_id) AS weight FROM (
 SELECT o_custkey AS portfolio_id, r_name AS ticker, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE AS spend FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)""")


def weights(spark, sf_dir):
    from pyspark.sql.window import Window
    lines = tb.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    orders = tb.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    home = tb.supplier_regions(spark, sf_dir).select("s_suppkey", "etf")
    # One exchange on the order serves both the sum per order and the join with orders.
    spend = (
        lines.join(home, F.col("l_suppkey") == F.col("s_suppkey"))
        .repartition("l_orderkey")
        .groupBy("l_orderkey", "etf").agg(F.sum("cents").alias("cents"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("portfolio_id"), F.col("etf").alias("ticker"))
        .agg(F.sum("cents").cast("double").alias("spend")))
    share = F.col("spend") / F.sum("spend").over(Window.partitionBy("portfolio_id"))
    return spend.select("portfolio_id", "ticker", share.alias("weight"))


part("simple_betas", "feat_region factors", f"""
SELECT r.ticker, factor, regr_slope(r.ret_1d, f) AS beta FROM feat_region r JOIN (
 {' UNION ALL '.join(f"SELECT lead(effective_date) OVER (ORDER BY effective_date) AS effective_date, '{f}' AS factor, {f} AS f FROM factors" for f in FACTORS)}) x
 ON x.effective_date = r.effective_date WHERE r.ret_1d IS NOT NULL AND f IS NOT NULL GROUP BY 1, 2""")


def simple_betas(spark, sf_dir):
    from pyspark.sql.window import Window
    w = Window.partitionBy("factor").orderBy("effective_date")
    # One row per date; stored, since the unpivot would read its source once per factor.
    wide = materialise(factors(spark, sf_dir), "factors")
    long = wide.unpivot(["effective_date"], list(FACTORS), "factor", "f").select(
        F.lead("effective_date", 1).over(w).alias("effective_date"), "factor", "f")
    rets = ft.add_returns(tb.bars(spark, sf_dir, "region"), (1,)).select("ticker", "effective_date", "ret_1d")
    return rets.join(long, "effective_date").groupBy("ticker", "factor").agg(F.regr_slope("ret_1d", "f").alias("beta"))


_SHOCKS = ", ".join(f"('{s}', '{f}', {x})" for s, shocks in pf.SCENARIOS.items() for f, x in shocks.items())


@plan("scenario_stress", "portfolio_id:i scenario:s factor_impact:f stressed_vol:f", "M24",
      with_parts("weights simple_betas regime_cov", f"""
, imp AS (SELECT portfolio_id, scenario, sum(weight * beta * shock * 0.01) AS factor_impact FROM weights JOIN simple_betas USING (ticker) JOIN (VALUES {_SHOCKS}) AS s(scenario, factor, shock) USING (factor) GROUP BY 1, 2),
idx AS (SELECT * FROM (VALUES {', '.join(f"('{r}', {i})" for i, r in enumerate(REGIONS))}) AS t(ticker, k)),
vol AS (SELECT a.portfolio_id, sqrt(greatest(sum(a.weight * b.weight * cov), 0)) AS stressed_vol FROM weights a JOIN idx ia ON ia.ticker = a.ticker JOIN weights b ON b.portfolio_id = a.portfolio_id
 JOIN idx ib ON ib.ticker = b.ticker JOIN regime_cov c ON c.i = ia.k AND c.j = ib.k AND regime = 'crisis' GROUP BY 1)
SELECT portfolio_id, scenario, factor_impact, stressed_vol FROM imp JOIN vol USING (portfolio_id)"""))
def _(spark, sf_dir):
    return pf.stress_test(weights(spark, sf_dir), simple_betas(spark, sf_dir), sample_cells(spark, sf_dir), list(REGIONS))


@plan("position_impact", "portfolio_id:i ticker:s vol_before:f vol_after:f vol_change:f eff_n_before:f eff_n_after:f effective_n_change:f error:s", "M25 A20",
      with_parts("weights regime_cov", f"""
, idx AS (SELECT * FROM (VALUES {', '.join(f"('{r}', {i})" for i, r in enumerate(REGIONS))}) AS t(ticker, k)),
c AS (SELECT c_custkey AS portfolio_id, CASE CAST(c_custkey % 4 AS INTEGER) WHEN 0 THEN 'ASIA' WHEN 1 THEN 'EUROPE' WHEN 2 THEN 'AFRICA' ELSE 'MOON' END AS ticker, 0.1 + (c_custkey % 5) / 10.0 AS target FROM customer),
g AS (SELECT c.portfolio_id, c.ticker AS cand, target, idx.ticker, k, coalesce(w.weight, 0) AS w FROM c, idx LEFT JOIN weights w ON w.portfolio_id = c.portfolio_id AND w.ticker = idx.ticker WHERE c.ticker <> 'MOON'),
h AS (SELECT *, sum(w) OVER p AS total, sum(CASE WHEN ticker <> cand THEN w ELSE 0 END) OVER p AS rest FROM g WINDOW p AS (PARTITION BY portfolio_id)),
a AS (SELECT *, CASE WHEN ticker = cand THEN target WHEN total < 1e-12 THEN 0 WHEN rest > 0 THEN w * (1 - target) / rest ELSE w END AS v FROM h),
q AS (SELECT x.portfolio_id, any_value(x.cand) AS ticker, sqrt(greatest(sum(x.w * y.w * cov), 0)) AS vol_before, sqrt(greatest(sum(x.v * y.v * cov), 0)) AS vol_after
 FROM a x JOIN a y USING (portfolio_id) JOIN regime_cov r ON r.i = x.k AND r.j = y.k AND regime = 'normal' GROUP BY 1),
e AS (SELECT portfolio_id, CASE WHEN sum(w * w) > 0 THEN 1 / sum(w * w) ELSE 0 END AS eff_n_before, CASE WHEN sum(v * v) > 0 THEN 1 / sum(v * v) ELSE 0 END AS eff_n_after FROM a GROUP BY 1)
SELECT portfolio_id, ticker, vol_before, vol_after, vol_after - vol_before AS vol_change, eff_n_before, eff_n_after, eff_n_after - eff_n_before AS effective_n_change, NULL AS error FROM q JOIN e USING (portfolio_id)
UNION ALL SELECT portfolio_id, ticker, 0, 0, 0, 0, 0, 0, 'MOON not in universe' FROM c WHERE ticker = 'MOON'"""))
def _(spark, sf_dir):
    k = F.col("c_custkey")
    wanted = tb.read(spark, sf_dir, "customer").select(
        k.alias("portfolio_id"), F.when(k % 4 == 0, "ASIA").when(k % 4 == 1, "EUROPE").when(k % 4 == 2, "AFRICA").otherwise("MOON").alias("ticker"),
        (0.1 + (k % 5) / 10.0).alias("target_weight"))
    return pf.position_impact(weights(spark, sf_dir), wanted, sample_cells(spark, sf_dir), list(REGIONS))


@plan("effective_positions", "portfolio_id:i effective_n:f", "A20",
      with_parts("weights", "SELECT portfolio_id, 1 / sum(weight * weight) AS effective_n FROM weights GROUP BY 1"))
def _(spark, sf_dir):
    w = pf.weight_vectors(weights(spark, sf_dir), list(REGIONS))
    return w.select("portfolio_id", pf.effective_n(F.col("w")).alias("effective_n"))


# ---- clusters: each region as three series, its return and the changes of volume and trade count
KINDS = ("ret", "volume", "trades")
SERIES = [f"{r}.{k}" for r in REGIONS for k in KINDS]
part("kinds", "bars_region", f"""
SELECT effective_date, ticker || '.' || kind AS name, v FROM (SELECT effective_date, ticker, close / lag(close) OVER w - 1 AS ret, ln(volume / lag(volume) OVER w) AS volume_, ln(n_trades / lag(n_trades) OVER w) AS trades
 FROM bars_region WINDOW w AS ({W})), LATERAL (VALUES ('ret', ret), ('volume', volume_), ('trades', trades)) AS t(kind, v) WHERE v IS NOT NULL""")
part("corr_edges", "kinds", """
SELECT a.name AS a, b.name AS b, corr(a.v, b.v) AS corr FROM kinds a JOIN kinds b ON a.effective_date = b.effective_date AND a.name <> b.name GROUP BY 1, 2
HAVING count(*) >= 30 AND abs(corr(a.v, b.v)) >= 0.75""")


def series_panel(spark, sf_dir):
    w = ft.series()
    step = lambda c: F.log(F.col(c) / F.lag(c, 1).over(w))
    df = tb.bars(spark, sf_dir, "region").select(
        "effective_date", "ticker", (F.col("close") / F.lag("close", 1).over(w) - 1).alias("ret"),
        step("volume").alias("volume"), step("n_trades").alias("trades"))
    long = df.unpivot(["effective_date", "ticker"], list(KINDS), "kind", "v").dropna()
    return mx.panel(long.withColumn("name", F.concat_ws(".", "ticker", "kind")), SERIES, name="name", value="v")


@plan("correlation_edges", "a:s b:s corr:f", "M26", with_parts("corr_edges", "SELECT * FROM corr_edges"))
def _(spark, sf_dir):
    return pf.correlation_edges(series_panel(spark, sf_dir), SERIES)


@plan("correlation_clusters", "component:s n_members:i combined_weight:f members:s warning:s", "M26",
      with_parts("corr_edges", """
, reach AS (SELECT a AS root, a AS node FROM corr_edges UNION SELECT r.root, e.b FROM reach r JOIN corr_edges e ON e.a = r.node),
c AS (SELECT node, min(root) AS component FROM reach GROUP BY 1)
SELECT component, count(*) AS n_members, count(*) * 0.05 AS combined_weight, string_agg(node, ',' ORDER BY node) AS members, 'These positions behave as a single trade.' AS warning FROM c GROUP BY 1""", recursive=True))
def _(spark, sf_dir):
    panel = series_panel(spark, sf_dir)
    held = spark.createDataFrame([(n, 0.05) for n in SERIES], "ticker string, weight double")
    edges = pf.held_edges(pf.correlation_edges(panel, SERIES), held)
    found = pf.clusters(pf.connected_components(edges), held)
    return found.withColumn("members", F.concat_ws(",", "members"))


HELD = [n for k, n in enumerate(SERIES) if k % 4 != 1]


@plan("correlation_clusters_held", "component:s n_members:i combined_weight:f members:s", "M26",
      with_parts("corr_edges", f"""
, h AS (SELECT * FROM corr_edges WHERE a IN ({', '.join(f"'{n}'" for n in HELD)}) AND b IN ({', '.join(f"'{n}'" for n in HELD)})),
reach AS (SELECT a AS root, a AS node FROM h UNION SELECT r.root, e.b FROM reach r JOIN h e ON e.a = r.node),
c AS (SELECT node, min(root) AS component FROM reach GROUP BY 1)
SELECT component, count(*) AS n_members, count(*) * 0.05 AS combined_weight, string_agg(node, ',' ORDER BY node) AS members FROM c GROUP BY 1""", recursive=True))
def _(spark, sf_dir):
    """One name in four is not held: two held names joined only through another stay apart."""
    held = spark.createDataFrame([(n, 0.05) for n in HELD], "ticker string, weight double")
    edges = pf.held_edges(pf.correlation_edges(series_panel(spark, sf_dir), SERIES), held)
    return pf.clusters(pf.connected_components(edges), held).withColumn("members", F.concat_ws(",", "members"))
