"""Queries of what is inferred from recordings and campaigns: likelihoods, linear solutions, evidence, chains, uncertainty and fits.

The linear model is that of `lineitem`: price on one, quantity, discount and tax, a ship year as epoch. Plans are fitted to the
waterfall of `events`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import chain, diagnostics, engines, evidence, inference, linear, memory, processing, reduced, sources, transforms, uncertainty, wide
from skyloom.operators.base import KEYS
from skyloom.plans.signal_path import assemble
from skyloom.plans.space import Bind, Forward, Joint, Latent, Normal, ParameterSpace, Uniform
from skyloom.queries import GRID, MD5, K, W, add, grid, table, waterfall

# --- likelihoods ----------------------------------------------------------------
_MU = 50.0
add(
    "radiometer_noise",
    lambda s, d: waterfall(s, d).select(*KEYS, F.round(inference.Radiometer(24.4e3, 288.0, 1.0).std(F.col("data")) * 1000, 5).alias("sigma")),
    f"with {W} select {K}, round(greatest(abs(data), 1.0) / sqrt(24.4e3 * 288.0) * 1000, 5) as sigma from w",
)
add(
    "inverse_variance",
    lambda s, d: processing.Flag(60.0)(waterfall(s, d)).select(
        *KEYS, F.round(inference.inverse_variance(inference.noise_model(F.lit(0.5) + F.col("freq_idx"), F.col("flag")).std(F.col("data"))), 6).alias("weight")
    ),
    f"with {W} select {K}, round(case when data > 60 then 0 else 1 / pow(0.5::double + freq_idx, 2) end, 6) as weight from w",
)
add(
    "loglik_gaussian",
    lambda s, d: waterfall(s, d).groupBy("freq_idx").agg(F.round(inference.log_likelihood(F.lit(_MU), F.col("data"), F.lit(25.0)) / 1000, 6).alias("loglik")),
    f"with {W} select freq_idx, round(-0.5 * sum(pow((data - 50) / 25, 2) + ln(2 * pi() * 625)) / 1000, 6) as loglik from w group by 1",
)
add(
    "loglik_masked",
    lambda s, d: processing.Flag(60.0)(waterfall(s, d)).groupBy("freq_idx").agg(
        F.round(inference.log_likelihood(F.lit(_MU), F.col("data"), inference.flagged_noise(F.lit(25.0), F.col("flag"))) / 1000, 6).alias("loglik")
    ),
    f"""with {W} select freq_idx, round(-0.5 * coalesce(sum(pow((data - 50) / 25, 2) + ln(2 * pi() * 625)) filter (where data <= 60), 0) / 1000, 6) as loglik
from w group by 1""",
)
add(
    "mse", lambda s, d: waterfall(s, d).groupBy("freq_idx").agg(F.round(inference.mean_squared_error(F.lit(_MU), F.col("data")) / 1000, 6).alias("mse")),
    f"with {W} select freq_idx, round(avg(pow(50 - data, 2)) / 1000, 6) as mse from w group by 1",
)

# --- linear model of lineitem ------------------------------------------------------
_COLS = ["one", "qty", "disc", "tax"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    scaled = [((F.col(c) * k).cast("double")).alias(n) for n, c, k in (("qty", "l_quantity", 1 / 25), ("disc", "l_discount", 10), ("tax", "l_tax", 10), ("y", "l_extendedprice", 1 / 40000))]
    return li.select(F.year("l_shipdate").cast("string").alias("epoch"), F.col("l_returnflag").alias("campaign"), F.lit(1.0).alias("one"), *scaled, F.lit(0.5).alias("sigma"))


_L = """l as (select cast(year(l_shipdate) as varchar) as epoch, l_returnflag as campaign, 1.0::double as x0, l_quantity / 25::double as x1,
  l_discount * 10::double as x2, l_tax * 10::double as x3, l_extendedprice / 40000::double as x4 from lineitem)"""
_PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]
_GRAM = "gram as (" + " union all ".join(f"select epoch, {i} as i, {j} as j, sum(x{i} * x{j}) as v, count(*) as n from l group by 1" for i, j in _PAIRS) + ")"
add(
    "gram_normal_equations",
    lambda s, d: inference.normal_matrix(_lines(s, d), _COLS, "y", F.lit(1.0), ["epoch"]).select("epoch", "i", "j", F.round(F.col("value") / 1000, 6).alias("value")),
    f"with {_L}, {_GRAM} select epoch, i, j, round(v / 1000, 6) as value from gram",
)


def _solution(spark: SparkSession, x, cov, digits: int = 6) -> DataFrame:
    return spark.createDataFrame([(i, round(float(v), digits), round(float(c) * 1e4, digits)) for i, (v, c) in enumerate(zip(x, np.diag(cov)))], "i int, mean double, var double")


_S2 = """s as (select 4 * sum(x0 * x0) + 0.01 as a, 4 * sum(x0 * x1) as b, 4 * sum(x1 * x1) + 0.01 as c, 4 * sum(x0 * x4) as p, 4 * sum(x1 * x4) as q from l)"""
_SOLVED = """select 0 as i, round((c * p - b * q) / (a * c - b * b), 6) as mean, round(c / (a * c - b * b) * 1e4, 6) as var from s
union all select 1, round((a * q - b * p) / (a * c - b * b), 6), round(a / (a * c - b * b) * 1e4, 6) from s"""
add("wiener_solve", lambda s, d: _solution(s, *linear.wiener_solve(_lines(s, d), ["one", "qty"], "y", "sigma", 10.0)), f"with {_L}, {_S2} {_SOLVED}")


def _gls(spark, sf_dir):
    found = linear.iterative_gls(_lines(spark, sf_dir), ["one", "qty"], "y", lambda mu: 0.1 + F.abs(mu), tol=1e-12)
    return spark.createDataFrame([(i, round(float(v), 4)) for i, v in enumerate(found.x)], "i int, value double")


add(
    "gls_iteration",
    _gls,
    f"""with recursive {_L}, d as (select x1, x4, row_number() over () as r from l),
t as (select 0 as n, 0.0::double as u, 0.0::double as v union all
  select n + 1, (c * p - b * q) / (a * c - b * b), (a * q - b * p) / (a * c - b * b) from (
    select t.n, sum(w) as a, sum(w * x1) as b, sum(w * x1 * x1) as c, sum(w * x4) as p, sum(w * x1 * x4) as q from (
      select t.n, d.*, case when t.n = 0 then 1 else 1 / pow(0.1 + abs(t.u + t.v * x1), 2) end as w from t, d where t.n < 25) t group by t.n))
select 0 as i, round(u, 4) as value from t where n = 25 union all select 1, round(v, 4) from t where n = 25""",
)

# --- evidence -----------------------------------------------------------------------


def _factors(spark, sf_dir, **more):
    return evidence.compress(_lines(spark, sf_dir), "epoch", _COLS, "y", "sigma", **more)


def _two(spark, sf_dir, **more):
    return evidence.compress(_lines(spark, sf_dir), "epoch", ["one", "qty"], "y", "sigma", **more)


def _info(factors: DataFrame, scale: float, *by: str) -> DataFrame:
    return evidence.fisher(factors).where("i <= j").select(*by, "i", "j", F.round(F.col("value") / scale, 6).alias("value"))


add("evidence_compress", lambda s, d: _info(_factors(s, d), 4000, "epoch"), f"with {_L}, {_GRAM} select epoch, i, j, round(v * 4 / 4000, 6) as value from gram where i < 4")
add(
    "evidence_combine", lambda s, d: _info(evidence.combine(_factors(s, d), None), 40000),
    f"with {_L}, {_GRAM} select i, j, round(sum(v) * 4 / 40000, 6) as value from gram where i < 4 group by 1, 2",
)
add(
    "evidence_offset",
    # at its best fit a factor's log likelihood is its offset; offset + chi2 / 2 is the normalisation of the data
    lambda s, d: _factors(s, d).select("epoch", "n_observed", F.round((F.col("log_offset") + F.col("corner") / 2) / 1000, 6).alias("log_norm")),
    f"with {_L} select epoch, count(*) as n_observed, round(-0.5 * count(*) * ln(2 * pi() * 0.25) / 1000, 6) as log_norm from l group by 1",
)
add(
    "evidence_log_likelihood",
    lambda s, d: evidence.log_likelihoods(_two(s, d), [(0.0, 0.0), (0.1, 0.8)]).select("epoch", "point", F.round(F.col("value") / 1000, 6).alias("value")),
    f"""with {_L}, p as (select * from (values (0, 0.0::double, 0.0::double), (1, 0.1, 0.8)) t(point, a, b))
select epoch, point, round(sum(-0.5 * (4 * pow(x4 - a - b * x1, 2) + ln(2 * pi() * 0.25))) / 1000, 6) as value from l, p group by 1, 2""",
)
_N1 = "n as (select epoch, 4 * sum(x1 * x1) as a, 4 * sum(x1) as b, 4 * count(*) as c, 4 * sum(x1 * x4) as p, 4 * sum(x4) as q from l group by 1)"
add(
    "evidence_nuisance",
    # the intercept integrated out under a prior of spread 0.2 about 0.1
    lambda s, d: _info(evidence.compress(_lines(s, d), "epoch", ["qty"], "y", "sigma", nuisance=["one"], nuisance_std=0.2, nuisance_mean=0.1), 1000, "epoch"),
    f"""with {_L}, {_N1} select epoch, 0 as i, 0 as j, round((a - b * b / (c + 25)) / 1000, 6) as value from n
union all select epoch, 0, 1, round((p - b * (q + 2.5) / (c + 25)) / 1000, 6) from n""",
)
add(
    "evidence_marginal", lambda s, d: _info(evidence.marginalise(_two(s, d), [0]), 1000, "epoch"),
    f"""with {_L}, {_N1} select epoch, 0 as i, 0 as j, round((a - b * b / c) / 1000, 6) as value from n
union all select epoch, 0, 1, round((p - b * q / c) / 1000, 6) from n""",
)


def _memory(spark, sf_dir):
    found = memory.Memory.of(_two(spark, sf_dir), ["one", "qty"], 0.0, 10.0)
    return _solution(spark, *found.posterior())


add("memory_posterior", _memory, f"with {_L}, {_S2} {_SOLVED}")

# --- chains --------------------------------------------------------------------------


def _chained(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("key", F.concat_ws("/", "campaign", "epoch"))
    f = evidence.compress(rows, "key", ["one", "qty"], "y", "sigma")
    return f.withColumns({"campaign": F.split("epoch", "/")[0], "seq": F.split("epoch", "/")[1].cast("long")})


def _marginal(spark, sf_dir):
    found = chain.chain_marginal(_chained(spark, sf_dir), chain.Transition.of(0.8, 0.05, 0.5))
    f = evidence.fisher(found.withColumn("epoch", F.col("campaign")))
    return f.select(F.col("epoch").alias("campaign"), "j", F.round(F.col("value") / 100, 6).alias("value"))


add(
    "chain_marginal",
    _marginal,
    # information on (theta, zeta): a block, then the step to the next state, the old one eliminated
    f"""with recursive {_L}, y as (select distinct campaign, epoch from l), o as (select *, row_number() over (partition by campaign order by epoch) as i, count(*) over (partition by campaign) as n from y),
b as (select campaign, epoch, 4 * count(*)::double as a, 4 * sum(x1) as b, 4 * sum(x1 * x1) as c, 4 * sum(x4) as p, 4 * sum(x1 * x4) as q from l group by 1, 2),
ob as (select * from o join b using (campaign, epoch)),
t as (select campaign, i, n, a, b, c + 4 as c, p, q from ob where i = 1 union all
  select t.campaign, t.i + 1, t.n, t.a - t.b * t.b / k + ob.a, t.b * 320 / k + ob.b, 400 - 320 * 320 / k + ob.c, t.p - t.b * t.q / k + ob.p, 320 * t.q / k + ob.q
  from (select *, c + 256 as k from t) t join ob on ob.campaign = t.campaign and ob.i = t.i + 1)
select campaign, 0 as j, round((a - b * b / c) / 100, 6) as value from t where i = n union all select campaign, 1, round((p - b * q / c) / 100, 6) from t where i = n""",
)


def _states(spark, sf_dir):
    found = chain.smooth(_chained(spark, sf_dir), chain.Transition.of(0.8, 0.05, 0.5), [0.3])
    return found.select("campaign", "seq", F.round(F.get("mean", F.lit(0)), 6).alias("mean"), F.round(F.get("var", F.lit(0)) * 1000, 6).alias("var"))


_B = """b as (select campaign, cast(epoch as bigint) as seq, 4 * sum(x1 * x1) as c, 4 * sum(x1 * (x4 - 0.3)) as q from l group by 1, 2),
o as (select *, row_number() over (partition by campaign order by seq) as i, count(*) over (partition by campaign) as n from b),
f as (select campaign, seq, i, n, q / (c + 4) as m, 1 / (c + 4) as v from o where i = 1 union all
  select f.campaign, o.seq, o.i, o.n, (o.q + 0.8 * f.m / (0.64 * f.v + 0.0025)) / (o.c + 1 / (0.64 * f.v + 0.0025)), 1 / (o.c + 1 / (0.64 * f.v + 0.0025))
  from f join o on o.campaign = f.campaign and o.i = f.i + 1)"""
add(
    "chain_states",
    _states,
    f"""with recursive {_L}, {_B}, ff as materialized (select *, 0.64 * v + 0.0025 as p from f),
s as (select campaign, seq, i, m, v from ff where i = n union all
  select ff.campaign, ff.seq, ff.i, ff.m + 0.8 * ff.v / p * (s.m - 0.8 * ff.m), ff.v + pow(0.8 * ff.v / p, 2) * (s.v - p) from s join ff on ff.campaign = s.campaign and ff.i = s.i - 1)
select campaign, seq, round(m, 6) as mean, round(v * 1000, 6) as var from s""",
)


def _series(spark, sf_dir, smooth):
    w = waterfall(spark, sf_dir).withColumn("series", F.concat_ws("/", "recording_id", "freq_idx"))
    found = chain.kalman(w, "series", "time_idx", "data", 0.8, 5.0, 10.0, 20.0, smooth)
    key = F.split("series", "/")
    return found.select(key[0].alias("recording_id"), "time_idx", key[1].cast("int").alias("freq_idx"), F.round("mean", 5).alias("mean"), F.round("var", 5).alias("var"))


_K = f"""{W}, k as (select recording_id, freq_idx, time_idx, data * 100 / (100 + 400) as m, 100 - 100 * 100.0::double / 500 as v from w where time_idx = 0
union all select w.recording_id, w.freq_idx, w.time_idx, 0.8 * k.m + (0.64 * k.v + 25) / (0.64 * k.v + 425) * (w.data - 0.8 * k.m), (1 - (0.64 * k.v + 25) / (0.64 * k.v + 425)) * (0.64 * k.v + 25)
from k join w on w.recording_id = k.recording_id and w.freq_idx = k.freq_idx and w.time_idx = k.time_idx + 1)"""
add("chain_filter", lambda s, d: _series(s, d, False), f"with recursive {_K} select {K}, round(m, 5) as mean, round(v, 5) as var from k")
add(
    "chain_smooth",
    lambda s, d: _series(s, d, True),
    f"""with recursive {_K}, kk as materialized (select *, 0.64 * v + 25 as p from k), b as (select recording_id, freq_idx, time_idx, m, v from kk where time_idx = 719
union all select kk.recording_id, kk.freq_idx, kk.time_idx, kk.m + 0.8 * kk.v / p * (b.m - 0.8 * kk.m), kk.v + pow(0.8 * kk.v / p, 2) * (b.v - p)
from b join kk on kk.recording_id = b.recording_id and kk.freq_idx = b.freq_idx and kk.time_idx = b.time_idx - 1)
select {K}, round(m, 5) as mean, round(v, 5) as var from b""",
)

# --- diagnostics ------------------------------------------------------------------------
_CHI = f"""with {_L}, g as (select epoch, count(*) as n, regr_sxx(x4, x1) as sxx, regr_sxy(x4, x1) as sxy, regr_syy(x4, x1) as syy from l group by 1),
c as (select epoch, 4 * (syy - sxy * sxy / sxx) as chi2, n - 2 as dof from g)"""


def _epochs(spark, sf_dir):
    return _two(spark, sf_dir).select(F.col("epoch").alias("epoch_id"), F.col("corner").alias("chi2"), "dof")


add(
    "epoch_residuals",
    lambda s, d: inference.epoch_residuals(_epochs(s, d)).select("epoch_id", F.round(F.col("chi2") / 1000, 6).alias("chi2"), "dof", F.round("reduced", 6).alias("reduced")),
    f"{_CHI} select epoch as epoch_id, round(chi2 / 1000, 6) as chi2, dof, round(chi2 / dof, 6) as reduced from c",
)
add(
    "coherent_mode",
    lambda s, d: inference.coherent_mode(_epochs(s, d)).select(F.round(F.col("mean_chi2") / 1000, 6).alias("mean_chi2"), F.round(F.col("chi2_z") / 100, 6).alias("chi2_z"), "n"),
    f"""{_CHI} select round(avg(chi2) / 1000, 6) as mean_chi2, round((sum(chi2) - sum(dof)) / sqrt(2 * sum(dof)) / 100, 6) as chi2_z, count(*) as n from c""",
)
add(
    "coherent_templates",
    lambda s, d: inference.coherent_templates(_two(s, d, templates=["disc", "tax"])).select("template", *(F.round(c, 5).alias(c) for c in ("mean", "std", "z")), "n"),
    f"""with {_L}, u as (unpivot l on x2, x3 into name template value t), m as (select *, x4 - avg(x4) over p as y0, x1 - avg(x1) over p as q0, t - avg(t) over p as t0 from u window p as (partition by template, epoch)),
r as (select *, y0 - q0 * sum(q0 * y0) over p / sum(q0 * q0) over p as y1, t0 - q0 * sum(q0 * t0) over p / sum(q0 * q0) over p as t1 from m window p as (partition by template, epoch)),
z as (select template, epoch, 2 * sum(t1 * y1) / sqrt(sum(t1 * t1)) as z from r group by 1, 2)
select case template when 'x2' then 'disc' else 'tax' end as template, round(avg(z), 5) as mean, round(stddev_pop(z), 5) as std, round(avg(z) * sqrt(count(*)), 5) as z, count(*) as n from z group by 1""",
)
add(
    "held_out_z",
    lambda s, d: memory.held_out_z(evidence.compress(_lines(s, d), "epoch", ["qty"], "y", "sigma")).select(F.col("epoch").alias("epoch_id"), "dof", F.round(F.col("z") / 100, 5).alias("z")),
    f"""with {_L}, e as (select epoch, sum(4 * x1 * x1) as p, sum(4 * x1 * x4) as s, sum(4 * x4 * x4) as c0, count(*) as n from l group by 1),
o as (select *, sum(p) over () - p as op, sum(s) over () - s as os from e)
select epoch as epoch_id, n as dof, round(((c0 - s * s / p + pow(s / p - os / op, 2) / (1 / p + 1 / op)) - n) / sqrt(2 * n) / 100, 5) as z from o""",
)
_SHRINK = f"with {_L}, e as (select campaign, count(*) as n, 1 / sqrt(sum(x1 * x1)) as sigma from l group by campaign, epoch)"


def _shrinking(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("campaign", "epoch").agg(F.count("*").alias("n"), (1 / F.sqrt(F.sum(F.col("qty") * F.col("qty")))).alias("sigma"))


add("shrinkage_power", lambda s, d: inference.shrinkage_power(_shrinking(s, d)).select(F.round("slope", 6).alias("slope")), f"{_SHRINK} select round(regr_slope(ln(sigma), ln(n)), 6) as slope from e")
add(
    "shrinkage_report", lambda s, d: inference.shrinkage_report(_shrinking(s, d), ["campaign"]).select("campaign", F.round("slope", 6).alias("slope"), "points", "averages"),
    f"""{_SHRINK} select campaign, round(regr_slope(ln(sigma), ln(n)), 6) as slope, count(*) as points, abs(regr_slope(ln(sigma), ln(n)) + 0.5) <= 0.1 as averages
from e group by 1""",
)
add(
    "split_rhat", lambda s, d: inference.split_rhat(waterfall(s, d), ["recording_id", "freq_idx"], "time_idx", "data").select("recording_id", "freq_idx", F.round("rhat", 6).alias("rhat")),
    f"""with {W}, h as (select recording_id, freq_idx, time_idx < 360 as h, avg(data) as m, var_samp(data) as v from w group by 1, 2, 3)
select recording_id, freq_idx, round(sqrt((359.0::double / 360 * avg(v) + var_samp(m)) / avg(v)), 6) as rhat from h group by 1, 2""",
)


def _identifiable(spark, sf_dir):
    found = diagnostics.identifiability(_lines(spark, sf_dir), ["one", "qty"], 0.5)
    return spark.createDataFrame([(i, round(float(x), 6), found.rank) for i, x in enumerate(found.singular)], "i int, singular double, rank int")


# the two singular values of columns of length one are sqrt(1 + c) and sqrt(1 - c), with c the cosine between them
_COS = "c as (select abs(sum(x0 * x1)) / sqrt(sum(x0 * x0) * sum(x1 * x1)) as c from l)"
add("identifiability", _identifiable, f"with {_L}, {_COS} select 0 as i, round(sqrt(1 + c), 6) as singular, 2 as rank from c union all select 1, round(sqrt(1 - c), 6), 2 from c")
add(
    "jeffreys_prior",
    lambda s, d: s.createDataFrame([(round(diagnostics.jeffreys_half_log_det(_lines(s, d), ["one", "qty"], 0.5), 6),)], "half_log_det double"),
    f"with {_L} select round(0.5 * ln(16 * (sum(x0 * x0) * sum(x1 * x1) - pow(sum(x0 * x1), 2))), 6) as half_log_det from l",
)

# --- blocks too wide for a triangle --------------------------------------------------------


def _levels(spark, sf_dir) -> wide.WideRows:
    """A level for each order and one slope on quantity."""
    entry = lambda unknown, a: F.struct(unknown.alias("unknown"), a.cast("double").alias("a"))
    g = F.col("l_orderkey").cast("string")
    t = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("cell"), (F.col("l_extendedprice") / 1000).alias("y"),
        F.lit(2.0).alias("sigma"), F.array(entry(g, F.lit(1.0)), entry(F.lit("slope"), F.col("l_quantity"))).alias("entries"), g.alias("g"),
    )
    levels = t.select(F.col("g").alias("unknown")).distinct().select("unknown", F.lit(30.0).alias("mean"), F.lit(10.0).alias("std"))
    slope = spark.createDataFrame([("slope", 0.5, 5.0)], levels.schema)
    return wide.WideRows(t.drop("g"), levels.unionByName(slope))


def _normal(seed: int, name: str, keys: str) -> str:
    u, v = (MD5.format(text=f"'{seed}:{name}/{k}:' || {keys}") for k in "uv")
    return f"sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v})"


_CELL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))"
#: One slope beside levels of their own: the levels go by elimination.
_WIDE = f"""with draw as (select unnest([0, 1, 2]) as draw),
t as (select draw, l_orderkey::varchar as g, l_quantity::double as x, (l_extendedprice / 1000 - 30 - 0.5 * l_quantity) / 2
  + case when draw = 0 then 0 else {_normal(4, "data", f"draw || ':' || {_CELL}")} end as e from lineitem, draw),
g as (select draw, g, sum(x) / 4 as b, sum(e) / 2 + case when draw = 0 then 0 else 0.1::double * {_normal(4, "prior", "draw || ':' || g")} end as c, count(*) / 4 + 0.01::double as d from t group by draw, g),
s as (select draw, sum(x * x) / 4 + 0.04::double as a, sum(x * e) / 2 + case when draw = 0 then 0 else 0.2::double * {_normal(4, "prior", "draw || ':slope'")} end as c from t group by draw),
k as (select s.draw, (any_value(s.c) - sum(b * g.c / d)) / (any_value(s.a) - sum(b * b / d)) as k from s join g on g.draw = s.draw group by s.draw)"""
_VALUES = "select draw, g as unknown, round(30 + (c - b * k) / d, 5) as value from g join k using (draw) {where} union all select draw, 'slope', round(0.5 + k, 5) from k {where}"


def _solved(spark, sf_dir, draws: int) -> DataFrame:
    return wide.wide_solve(_levels(spark, sf_dir), draws, seed=4, tol=1e-11).values.select("draw", "unknown", F.round("value", 5).alias("value"))


add("wide_solve", lambda s, d: _solved(s, d, 0), f"{_WIDE} {_VALUES.format(where='where draw = 0')}")
add("wide_draws", lambda s, d: _solved(s, d, 2).where("draw > 0"), f"{_WIDE} {_VALUES.format(where='where draw > 0')}")

# --- plans with unknowns ----------------------------------------------------------------


def _curved(spark, sf_dir) -> Forward:
    space = ParameterSpace([Latent("amp", 180.0, Normal(180.0, 2.0)), Latent("beta", 2.5, Uniform(2.5, 2.6))], [Bind("amp", "foregrounds.amplitude"), Bind("beta", "foregrounds.spectral_index")])
    return Forward(space, assemble(sources.Foreground(180.0, 2.5)), grid(spark, sf_dir))


def _affine(spark, sf_dir, *latents) -> engines.Problem:
    """A foreground's amplitude, an offset and lines in every fourth channel: those named are unknown."""
    fields = {"amp": "foregrounds.amplitude", "off": "uniform_sky.amplitude", "line": "emi.amplitude"}
    space = ParameterSpace([Latent(n, 1.0, Normal(100.0, 10.0), linear=True) for n in latents], [Bind(n, fields[n]) for n in latents])
    plan = assemble(sources.Foreground(0.0, 2.5), sources.UniformSky(0.0), transforms.PeriodicLines(0.0, 4))
    seen = waterfall(spark, sf_dir).select(*KEYS, F.col("data").alias("value"))
    return engines.Problem(Forward(space, plan, grid(spark, sf_dir)), seen, 25.0)


_F = "pow(freq_hz / 75e6, -2.5)"
_J = f"j as (select *, {_F} as a, -180 * ln(freq_hz / 75e6) * {_F} as b from g)"
add(
    "forward_predict", lambda s, d: _curved(s, d).predict({"amp": 150.0, "beta": 2.2}).select(*KEYS, F.round("data", 5).alias("data")),
    f"with {GRID} select {K}, round(150 * pow(freq_hz / 75e6, -2.2), 5) as data from g",
)


def _designed(spark, sf_dir):
    block = linear.linear_operator(_affine(spark, sf_dir, "amp", "line").forward, ["amp", "line"])
    return block.rows.select(*KEYS, F.posexplode("a").alias("i", "a"), "offset").select(*KEYS, "i", F.round("a", 6).alias("a"), F.round("offset", 6).alias("offset"))


add(
    "linear_design", _designed,
    f"""with {GRID} select {K}, 0 as i, round({_F}, 6) as a, 0.0::double as "offset" from g
union all select {K}, 1, case when freq_idx % 4 = 0 then 1.0::double else 0 end, 0.0::double from g""",
)
_N2 = f"""x as (select {_F} as x0, case when freq_idx % 4 = 0 then 1.0::double else 0 end as x1, data as y from w),
s as (select sum(x0 * x0) / 625 + 0.01 as a, sum(x0 * x1) / 625 as b, sum(x1 * x1) / 625 + 0.01 as c, sum(x0 * y) / 625 + 1 as p, sum(x1 * y) / 625 + 1 as q from x)"""


def _block_solved(spark, sf_dir):
    problem = _affine(spark, sf_dir, "amp", "line")
    block = linear.linear_operator(problem.forward, ["amp", "line"])
    seen = waterfall(spark, sf_dir).select(*KEYS, F.col("data").alias("value"))
    return _solution(spark, *linear.solve_block(block, seen, 25.0), 5)


_SOLVED5 = _SOLVED.replace(", 6)", ", 5)")
add("linear_block_solve", _block_solved, f"with {W}, {_N2} {_SOLVED5}")


def _planned(spark, sf_dir):
    plan = engines.SamplingPlan(_affine(spark, sf_dir, "amp", "line"), engines.Block("amp"), engines.Block("line"))
    found = plan.estimate(tol=1e-15, most=500)
    return spark.createDataFrame([(i, round(float(x), 4)) for i, x in enumerate(found.theta)], "i int, mean double")


add(
    "sampling_plan", _planned,
    f"with {W}, {_N2} select 0 as i, round((c * p - b * q) / (a * c - b * b), 4) as mean from s union all select 1, round((a * q - b * p) / (a * c - b * b), 4) from s",
)
_N3 = f"x as (select {_F} as x0, data as y from w), s as materialized (select sum(x0 * x0) as a, sum(x0 * y) as p, count(*) as n from x)"


def _descended(spark, sf_dir):
    theta, _ = engines.GradientCalibrator(0.2, 4).fit(_affine(spark, sf_dir, "amp"))
    return spark.createDataFrame([(round(float(theta[0]), 5),)], "amp double")


add(
    "gradient_fit", _descended,
    f"""with recursive {W}, {_N3}, t as (select 0 as k, 1.0::double as v union all select k + 1, v - 0.2 * 2 / n * (v * a - p) from t, s where k < 4)
select round(v, 5) as amp from t where k = 4""",
)


def _adam(spark, sf_dir):
    theta, _ = engines.AdamCalibrator(2.0, 3).fit(_affine(spark, sf_dir, "amp"))
    return spark.createDataFrame([(round(float(theta[0]), 5),)], "amp double")


add(
    "adam_fit", _adam,
    f"""with recursive {W}, {_N3}, t as (select 0 as k, 1.0::double as v, 0.0::double as m, 0.0::double as u union all
  select k + 1, v - 2 * (0.9 * m + 0.1 * g) / (1 - pow(0.9, k + 1)) / (sqrt((0.999 * u + 0.001 * g * g) / (1 - pow(0.999, k + 1))) + 1e-8), 0.9 * m + 0.1 * g, 0.999 * u + 0.001 * g * g
  from (select *, 2 / n * (v * a - p) as g from t, s) where k < 3)
select round(v, 5) as amp from t where k = 3""",
)


def _sensitivity(spark, sf_dir):
    r = engines.prior_sensitivity(_affine(spark, sf_dir, "amp"))
    return spark.createDataFrame([tuple(round(float(x[0]), 5) for x in (r.mode, r.data_mode, r.sigma, r.shift))], "mode double, data_mode double, sigma double, shift double")


add(
    "prior_sensitivity", _sensitivity,
    f"""with {W}, {_N3}, m as (select (p / 625 + 1) / (a / 625 + 0.01) as m, p / a as d, 1 / sqrt(a / 625 + 0.01) as s from s)
select round(m, 5) as mode, round(d, 5) as data_mode, round(s, 5) as sigma, round((m - d) / s, 5) as shift from m""",
)


def _points(spark, sf_dir):
    found = _affine(spark, sf_dir, "amp", "off").log_likelihoods([(0.0, 0.0), (30.0, 20.0)])
    return spark.createDataFrame([(i, round(float(v) / 1000, 5)) for i, v in enumerate(found)], "point int, value double")


add(
    "plan_log_likelihood", _points,
    f"""with {W}, p as (select * from (values (0, 0.0::double, 0.0::double), (1, 30, 20)) t(point, a, b))
select point, round(sum(-0.5 * (pow((data - a * {_F} - b) / 25, 2) + ln(2 * pi() * 625))) / 1000, 5) as value from w, p group by 1""",
)

# --- uncertainty ----------------------------------------------------------------------------


def _fisher(spark, sf_dir):
    found = uncertainty.fisher_information(_curved(spark, sf_dir), inference.Radiometer(24.4e3, 288.0)).value / 1e6
    return spark.createDataFrame([(i, j, round(float(found[i, j]), 3)) for i in range(2) for j in range(i, 2)], "i int, j int, value double")


_Q = "(24.4e3 * 288 + 2) / pow(180 * a, 2)"
add(
    "fisher_information", _fisher,
    f"""with {GRID}, {_J} select 0 as i, 0 as j, round(sum(a * a * {_Q}) / 1e6, 3) as value from j union all select 0, 1, round(sum(a * b * {_Q}) / 1e6, 3) from j
union all select 1, 1, round(sum(b * b * {_Q}) / 1e6, 3) from j""",
)


def _propagated(spark, sf_dir):
    forward = _curved(spark, sf_dir)
    cov = uncertainty.FlatMatrix(forward.space, ("amp", "beta"), np.array([[4.0, 0.01], [0.01, 0.0025]]))
    return uncertainty.propagate_covariance(forward, cov).select(*KEYS, F.round("std", 5).alias("std"))


add("propagate_covariance", _propagated, f"with {GRID}, {_J} select {K}, round(sqrt(4 * a * a + 0.02 * a * b + 0.0025 * b * b), 5) as std from j")


def _pushed(spark, sf_dir):
    forward = _curved(spark, sf_dir)
    return uncertainty.push_forward(forward, forward.space.draws(spark, 20, 3)).select(*KEYS, F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "n")


_DRAWS = f"""d as (select d, 180 + 2 * sqrt(-2 * ln(1 - {MD5.format(text="'3:amp/0/u:' || d")})) * cos(2 * pi() * {MD5.format(text="'3:amp/0/v:' || d")}) as amp,
  2.5 + 0.1::double * {MD5.format(text="'3:beta/0:' || d")} as beta from range(20) a(d))"""
add(
    "push_forward", _pushed,
    f"""with {GRID}, {_DRAWS}, x as (select {K}, amp * pow(freq_hz / 75e6, -beta) as x from g, d)
select {K}, round(avg(x), 5) as mean, round(stddev_pop(x), 5) as std, count(*) as n from x group by 1, 2, 3""",
)


def _simulated(spark, sf_dir):
    return engines.simulate_pairs(_curved(spark, sf_dir), 0.5, 3, 3, spark).select("draw_id", *KEYS, F.round("data", 5).alias("data"))


_NOISE = "'3:pairs/{x}:' || d || ':' || recording_id || ':' || time_idx || ':' || freq_idx"
add(
    "simulate_pairs", _simulated,
    f"""with {GRID}, {_DRAWS} select d as draw_id, {K}, round(amp * pow(freq_hz / 75e6, -beta)
  + 0.5::double * sqrt(-2 * ln(1 - {MD5.format(text=_NOISE.format(x="u"))})) * cos(2 * pi() * {MD5.format(text=_NOISE.format(x="v"))}), 5) as data from g, d where d < 3""",
)

# --- reduced bases ----------------------------------------------------------------------------
_CHANNEL_NOISE = [1.0, 2.0, 1.0, 2.0, 1.0]


def _bank(spark, sf_dir):
    row = F.transform(F.array_sort(F.collect_list(F.struct("freq_idx", "data"))), lambda x: x["data"])
    return waterfall(spark, sf_dir).groupBy("recording_id", "time_idx").agg(row.alias("spectrum"))


def _lost(method, n):
    def query(spark, sf_dir):
        basis = reduced.build_reduced_basis(_bank(spark, sf_dir), "spectrum", n, _CHANNEL_NOISE, method)
        return spark.createDataFrame([(round(basis.lost, 6),)], "lost double")

    return query


# of all five channels; singular values of five have no closed form, so a test holds them against NumPy
add("reduced_basis", _lost("svd", 2), None)
add(
    "reduced_basis_greedy", _lost("greedy", 1),
    f"""with {W}, b as (select recording_id, time_idx, list(data / case freq_idx % 2 when 1 then 2 else 1 end order by freq_idx) as v from w group by 1, 2),
m as (select arg_max(v, list_inner_product(v, v)) as u from b)
select round(1 - sum(pow(list_inner_product(v, u), 2) / list_inner_product(u, u)) / sum(list_inner_product(v, v)), 6) as lost from b, m""",
)


def _reduced_factors(spark, sf_dir):
    basis = reduced.ReducedBasis(np.eye(5)[:2], np.array(_CHANNEL_NOISE), 0.0)
    rows = waterfall(spark, sf_dir).withColumn("sigma", F.lit(2.0))
    return reduced.compress_reduced(rows, "recording_id", basis, "freq_idx", "data", "sigma").select("epoch", "n_observed", F.size("z").alias("width"), F.round(F.col("corner") / 1e5, 6).alias("chi2"))


add(
    "evidence_reduced_basis", _reduced_factors,
    f"""with {W} select recording_id as epoch, count(*) as n_observed, 2 as width, round((coalesce(var_pop(data) filter (where freq_idx = 0) * 720, 0)
  + var_pop(data) filter (where freq_idx = 1) * 720 + sum(data * data) filter (where freq_idx > 1)) / 4 / 1e5, 6) as chi2 from w group by 1""",
)


def _power_law(spark, sf_dir) -> Forward:
    space = ParameterSpace([Latent("amp", 180.0)], [Bind("amp", "foregrounds.amplitude")])
    return Forward(space, assemble(sources.Foreground(180.0, 2.5)), grid(spark, sf_dir))


def _certified(spark, sf_dir) -> DataFrame:
    """Each recording is an epoch; noise in proportion to a power law, whose amplitude may move by five hundredths."""
    forward, seen = _power_law(spark, sf_dir), waterfall(spark, sf_dir).select(*KEYS, F.col("data").alias("value"), F.col("recording_id").alias("night"))
    noise, white = inference.Radiometer(1.0, 100.0, 1.0), np.array([18 * (60 / 75 + i / 15) ** -2.5 for i in range(5)])
    basis = reduced.ReducedBasis(np.ones((1, 5)) / 5**0.5, white, 0.0)
    found = reduced.compress_certified(forward, seen, "night", basis, noise, {"amp": (171.0, 189.0)}, 1e9)
    return found.select("epoch", F.round(F.col("frozen_gap") / 1000, 5).alias("frozen_gap"), F.round(F.abs(F.element_at("z", 1)), 4).alias("z"), "n_observed")


_GAP = "sum(-0.5 * pow((data - {m}) / s, 2) - ln(s) + 0.5 * pow((data - {m}) / ({k} * s), 2) + ln({k} * s))"
add(
    "certified_factors", _certified,
    f"""with {W}, x as (select recording_id, data, 180 * pow(freq_hz / 75e6, -2.5) as mu, 18 * pow(freq_hz / 75e6, -2.5) as s from w)
select recording_id as epoch, round(greatest(abs({_GAP.format(m="0.95 * mu", k="0.95::double")}), abs({_GAP.format(m="1.05 * mu", k="1.05::double")})) / 1000, 5) as frozen_gap,
  round(abs(sum(data / s / sqrt(5))) / sqrt(count(*) / 5), 4) as z, count(*) as n_observed from x group by 1""",
)


def _joint(spark, sf_dir) -> DataFrame:
    """A level and a power law under a prior that ties them: mean and variance of both."""
    space = ParameterSpace(
        [Latent("sky", 10.0), Latent("amp", 50.0)], [Bind("sky", "uniform_sky.amplitude"), Bind("amp", "foregrounds.amplitude")], [Joint(["sky", "amp"], [10.0, 50.0], [[25.0, -10.0], [-10.0, 100.0]])]
    )
    forward = Forward(space, assemble(sources.UniformSky(1.0), sources.Foreground(1.0, 2.5)), grid(spark, sf_dir))
    block = linear.linear_operator(forward, ["sky", "amp"], check=False)
    x, cov = linear.solve_block(block, waterfall(spark, sf_dir).select(*KEYS, F.col("data").alias("value")), 2000.0)
    return spark.createDataFrame([(i, round(float(x[i]), 5), round(float(cov[i, i]), 5)) for i in range(2)], "i int, mean double, var double")


add(
    "joint_prior", _joint,
    f"""with {W}, x as (select data as y, pow(freq_hz / 75e6, -2.5) as g from w),
m as (select count(*) / 4e6::double + 100.0::double / 2400 as a, sum(g) / 4e6 + 10.0::double / 2400 as b, sum(g * g) / 4e6 + 25.0::double / 2400 as c,
  sum(y) / 4e6 + (100 * 10 + 10 * 50)::double / 2400 as p, sum(y * g) / 4e6 + (10 * 10 + 25 * 50)::double / 2400 as q from x)
select 0 as i, round((c * p - b * q) / (a * c - b * b), 5) as mean, round(c / (a * c - b * b), 5) as var from m
union all select 1, round((a * q - b * p) / (a * c - b * b), 5), round(a / (a * c - b * b), 5) from m""",
)
