"""Scans of a sky by a turned beam: `embeddings` are a map (a channel for each label), `events` the samples and what they saw.

The SQL sums over all pixels of every sample, where the operators go by harmonics; the beam is a sum of Legendre polynomials of the angle to its axis.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import harmonics
from skyloom.queries import TYPES, add, hour, table

NSIDE, LMAX, LAT = 8, 4, 53.2
#: The beam: shares of P_0 to P_4.
SHARES = [1.0, 0.8, 0.5, 0.3, 0.1]
AZ, EL = 120.0, 55.0


def sky(s: SparkSession, d: str) -> DataFrame:
    """All components of all vectors, one after the other around the pixels."""
    rows = table(s, d, "embeddings").select(F.col("vec_id"), F.col("label").alias("freq_idx"), F.posexplode("embedding").alias("pos", "x"))
    return rows.select("freq_idx", F.pmod(F.col("vec_id") * 64 + F.col("pos"), F.lit(12 * NSIDE**2)).alias("pix"), F.col("x").cast("double").alias("value"))


def samples(s: SparkSession, d: str) -> DataFrame:
    """A sample for each hour with events; who acts in it says where the antenna points."""
    t = table(s, d, "events").groupBy(hour().alias("time_idx")).agg(F.sum("user_id").alias("users"), F.count("*").alias("n"))
    return t.select("time_idx", (F.col("time_idx") * 15.0411).alias("lst_deg"), F.pmod("users", F.lit(360)).cast("double").alias("az_deg"), (20 + F.col("n") % 70).cast("double").alias("el_deg"))


def seen(s: SparkSession, d: str) -> DataFrame:
    place = F.array_position(F.array(*(F.lit(t) for t in TYPES)), F.col("event_type")).cast("int") - 1
    return table(s, d, "events").groupBy(hour().alias("time_idx"), place.alias("freq_idx")).agg(F.sum("value").alias("value"))


def general(s: SparkSession, channels: int) -> harmonics.GeneralPointing:
    return harmonics.GeneralPointing(harmonics.zonal_beam(s, SHARES, channels), LAT, NSIDE, LMAX)


def drift(s: SparkSession, channels: int) -> harmonics.DriftScan:
    return harmonics.DriftScan(harmonics.zonal_beam(s, SHARES, channels), LAT, AZ, EL, NSIDE, LMAX, lst_ref_deg=30.0)


def _rounded(df: DataFrame, digits: int, *values: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in values), *((F.round(v, digits) + 0.0).alias(v) for v in values))


def _powers() -> str:
    """Rows (l, m, k, c): normalised Legendre functions are sin^m times the sum of c z^k."""
    rows = []
    for l in range(LMAX + 1):  # noqa: E741
        for m in range(l + 1):
            p = (np.polynomial.Polynomial([-1, 0, 1]) ** l).deriv(l + m) if l + m else np.polynomial.Polynomial([1.0])
            c = (-1) ** m * math.sqrt((2 * l + 1) / (4 * math.pi) * math.factorial(l - m) / math.factorial(l + m)) / (2**l * math.factorial(l))
            rows += [f"({l}, {m}, {k}, {float(c * x)!r}::double)" for k, x in enumerate(p.coef) if x]
    return ", ".join(rows)


_CAP, _N, _W = 2 * NSIDE * (NSIDE - 1), 12 * NSIDE**2, 4 * NSIDE
PIX = f"""pole as (
  select p, case when p < {_CAP} then 1 when p < {_N - _CAP} then 0 else -1 end as side, case when p < {_CAP} then p else {_N} - 1 - p end as q from range({_N}) t(p)
), ring as (select *, case when side <> 0 then floor((1 + sqrt(1 + 2 * q)) / 2) else (p - {_CAP}) // {_W} + {NSIDE} end::bigint as k from pole),
polar as (
  select p, case when side = 0 then 4.0::double / 3 - 2.0::double * k / {3 * NSIDE} else side * (1 - k * k / {3.0 * NSIDE**2}::double) end as z,
    case when side = 0 then ((p - {_CAP}) % {_W} + ((k - {NSIDE} + 1) % 2) / 2.0::double) * 2 * pi() / {_W}
      when side = 1 then (p - 2 * k * (k - 1) + 0.5::double) * 2 * pi() / (4 * k) else (p - {_N} + 2 * k * (k + 1) + 0.5::double) * 2 * pi() / (4 * k) end as phi from ring
), px as (select p, z, phi, sqrt(1 - z * z) * cos(phi) as x, sqrt(1 - z * z) * sin(phi) as y from polar)"""
SKY = f"""sk as (
  select label as freq_idx, ((vec_id * 64 + i - 1) % {_N}) as p, sum(cast(embedding[i] as double)) as v from embeddings, range(1, 65) t(i) group by 1, 2)"""
_HOUR = "cast(date_diff('hour', timestamp '2024-01-01', date_trunc('hour', ts)) as int)"
SAMPLES = f"""samp as (
  select time_idx, radians(time_idx * 15.0411::double) as lst, radians(users % 360) as az, radians(20 + n % 70) as el
  from (select {_HOUR} as time_idx, sum(user_id)::bigint as users, count(*) as n from events group by 1)
)"""
SEEN = f"""seen as (
  select {_HOUR} as time_idx, cast(list_position(['click','error','purchase','signup','view'], event_type) - 1 as int) as freq_idx, sum(value) as v from events group by 1, 2)"""


def _beam(az: str, el: str) -> str:
    """b: the turned beam at every pixel of every sample."""
    lat, level = f"radians({LAT}::double)", f"cos({el}) * cos({az})"
    legendre = " + ".join(f"{c}::double * ({p})" for c, p in zip(SHARES, ("1", "c", "(3 * c * c - 1) / 2", "(5 * c * c * c - 3 * c) / 2", "(35 * c * c * c * c - 30 * c * c + 3) / 8")))
    return f"""axis as (
  select time_idx, cos(lst) * h - sin(lst) * e as x, sin(lst) * h + cos(lst) * e as y, {level} * cos({lat}) + sin({el}) * sin({lat}) as z
  from (select *, sin({el}) * cos({lat}) - {level} * sin({lat}) as h, cos({el}) * sin({az}) as e from samp)
), b as (select time_idx, p, {legendre} as b from (select a.time_idx, px.p, a.x * px.x + a.y * px.y + a.z * px.z as c from axis a, px))"""


add(
    "sky_coefficients", lambda s, d: _rounded(harmonics.analyse(sky(s, d), NSIDE, LMAX), 5, "re", "im"),
    f"""with {PIX}, {SKY}, c as (select * from (values {_powers()}) t(l, m, k, c)),
lam as (select p, phi, l, m, pow(1 - z * z, m / 2.0::double) * sum(c * pow(z, k)) as lam from px, c group by p, phi, z, l, m)
select freq_idx, cast(l as int) as l, cast(m as int) as m, round(sum(v * lam * cos(m * phi)), 5) + 0.0 as re, round(-sum(v * lam * sin(m * phi)), 5) + 0.0 as im
from sk join lam using (p) group by 1, 2, 3""",
)
add(
    "drift_scan", lambda s, d: _rounded(drift(s, 10).forward(sky(s, d), samples(s, d)), 5, "value"),
    f"""with {PIX}, {SKY}, {SAMPLES}, {_beam(f"radians({AZ}::double)", f"radians({EL}::double)")}
select time_idx, freq_idx, round(sum(v * b), 5) + 0.0 as value from b join sk using (p) group by 1, 2""",
)
add(
    "drift_scan_adjoint", lambda s, d: _rounded(drift(s, 5).adjoint(seen(s, d), samples(s, d)), 4, "value"),
    f"""with {PIX}, {SEEN}, {SAMPLES}, {_beam(f"radians({AZ}::double)", f"radians({EL}::double)")}
select freq_idx, p as pix, round(sum(v * b), 4) + 0.0 as value from b join seen using (time_idx) group by 1, 2""",
)
add(
    "pointed_scan", lambda s, d: _rounded(general(s, 10).forward(sky(s, d), samples(s, d)), 5, "value"),
    f"""with {PIX}, {SKY}, {SAMPLES}, {_beam("az", "el")}
select time_idx, freq_idx, round(sum(v * b), 5) + 0.0 as value from b join sk using (p) group by 1, 2""",
)
add(
    "pointed_scan_adjoint", lambda s, d: _rounded(general(s, 5).adjoint(seen(s, d), samples(s, d)), 4, "value"),
    f"""with {PIX}, {SEEN}, {SAMPLES}, {_beam("az", "el")}
select freq_idx, p as pix, round(sum(v * b), 4) + 0.0 as value from b join seen using (time_idx) group by 1, 2""",
)
