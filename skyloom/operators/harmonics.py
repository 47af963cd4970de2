"""Spherical harmonics of pixel tables, and scans of a sky by a rotated beam.

A map is a table (freq_idx, pix, value) of equal-area pixels on rings; coefficients are a table (freq_idx, l, m, re, im) of m >= 0, as maps are real.
Analysis takes Fourier sums of each ring and weighs them by that ring's Legendre functions; the rings' shares are summed by aggregates. Synthesis goes
the other way, one (channel, m) at a time. Both are plain sums over pixels, so that one is the other's transpose.

A beam turned by R has the coefficients D(R) b. With R = Rz(a) Ry(b) Rz(c) these are Z(a + pi/2) d Z(b) d' Z(c - pi/2) b, where Z are phases and d, Wigner's
matrix of a right angle, is the same for all samples: a batch of samples is two products of matrices for each l. In a drift scan only the first phase moves, so
that the beam is turned once and samples are sums of m-modes.

The sky's frame has its pole at the celestial pole and longitude along right ascension. The beam's own frame has its axis at the pole; az runs from north by east.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.errors import ParameterError
from skyloom.operators.projection import mmode_synthesis

#: Bytes of coefficients that every task may hold; more channels are turned in several passes.
HELD_BYTES = 32 << 20
_SMALL = 2.0**-512


# --- pixels --------------------------------------------------------------------
def ring_of(pix: Column, nside: int) -> Column:
    """The ring of a pixel, from 1 at the north."""
    cap, n = 2 * nside * (nside - 1), 12 * nside * nside
    north = F.floor((1 + F.sqrt(1.0 + 2 * pix)) / 2)
    # the root of a large square may be rounded to the next ring
    north = north + F.when(2 * north * (north + 1) <= pix, 1).when(2 * north * (north - 1) > pix, -1).otherwise(0)
    turned = n - 1 - pix
    south = F.floor((1 + F.sqrt(1.0 + 2 * turned)) / 2)
    south = south + F.when(2 * south * (south + 1) <= turned, 1).when(2 * south * (south - 1) > turned, -1).otherwise(0)
    return F.when(pix < cap, north).when(pix < n - cap, F.floor((pix - cap) / (4 * nside)) + nside).otherwise(4 * nside - south).cast("int")


def ring_start(ring: Column, nside: int) -> Column:
    """The first pixel of a ring."""
    cap, n = 2 * nside * (nside - 1), 12 * nside * nside
    below = 4 * nside - ring
    ring = ring.cast("long")
    return F.when(ring < nside, 2 * ring * (ring - 1)).when(ring <= 3 * nside, cap + (ring - nside) * 4 * nside).otherwise(n - 2 * below * (below + 1))


def ring_geometry(ring: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cosine of the colatitude, number of pixels and longitude of the first pixel of rings."""
    at = np.minimum(ring, 4 * nside - ring)
    polar = at < nside
    z = np.where(polar, 1 - at**2 / (3.0 * nside**2), 4 / 3 - 2.0 * at / (3 * nside))
    size = np.where(polar, 4 * at, 4 * nside)
    half = np.where(polar, 0.5, ((ring - nside + 1) % 2) / 2)  # of a pixel
    return np.where(ring > 2 * nside, -z, z), size, 2 * np.pi * half / size


def _check(nside: int, lmax: int) -> None:
    if nside < 1 or lmax < 0 or lmax > 4 * nside:
        raise ParameterError(f"nside must be positive and lmax between 0 and 4 nside, not {nside} and {lmax}")


def _pixels(maps: DataFrame, nside: int) -> DataFrame:
    pix = F.col("pix").cast("long")
    fits = pix.isNull() | ((pix >= 0) & (pix < 12 * nside * nside))
    checked = F.when(fits, pix).otherwise(F.raise_error(F.concat(F.lit("no such pixel: "), pix.cast("string"))).cast("long"))
    return maps.where(F.col("value").isNotNull() & F.col("pix").isNotNull()).select(F.col("freq_idx").cast("int").alias("freq_idx"), checked.alias("pix"), F.col("value").cast("double").alias("value"))


# --- Legendre functions and Wigner matrices ------------------------------------
def legendre(z: np.ndarray, m: int, lmax: int) -> np.ndarray:
    """(lmax + 1 - m, points): normalised Legendre functions of order m, by the three-term recurrence in l.

    Values are kept with powers of 2^512 of their own, so that what is too small for a double at low l still grows to its size at high l.
    """
    z = np.asarray(z, float)
    log = 0.5 * (math.log((2 * m + 1) / (4 * math.pi)) + sum(math.log1p(-1 / (2 * k)) for k in range(1, m + 1)))
    with np.errstate(divide="ignore"):
        log = (log + (0.5 * m * np.log1p(-z * z) if m else 0.0)) / math.log(2) + np.zeros(len(z))
    log = np.maximum(log, -1e6)
    power = np.minimum(np.ceil(log / 512), 0).astype(int)
    now, before = (-1) ** m * 2.0 ** (log - 512 * power), np.zeros(len(z))
    out = np.zeros((lmax + 1 - m, len(z)))
    for l in range(m, lmax + 1):  # noqa: E741
        if l > m:
            a = math.sqrt((4 * l * l - 1) / (l * l - m * m))
            b = math.sqrt(((l - 1) ** 2 - m * m) / (4 * (l - 1) ** 2 - 1)) if l > m + 1 else 0.0
            now, before = a * (z * now - b * before), now
            large = (np.abs(now) > 1) & (power < 0)
            if large.any():
                now, before = np.where(large, now * _SMALL, now), np.where(large, before * _SMALL, before)
                power = power + large
        out[l - m] = np.where(power == 0, now, 0.0)  # a negative power is below 2^-512
    return out


def right_angle(lmax: int) -> list[np.ndarray]:
    """Wigner's d of a right angle for l = 0..lmax, each (2l+1, 2l+1): by recurrence in l, from the outermost rows and columns."""
    n = lmax
    m = np.arange(-n, n + 1, dtype=float)
    a, b = np.meshgrid(m, m, indexing="ij")
    last, now, out = np.zeros((2 * n + 1,) * 2), np.zeros((2 * n + 1,) * 2), []
    for l in range(lmax + 1):  # noqa: E741
        new = np.zeros_like(now)
        if l > 1:
            j = l - 1
            s = slice(n - j, n + j + 1)
            x, y = a[s, s], b[s, s]
            root = np.sqrt((l * l - x * x) * (l * l - y * y))
            new[s, s] = l / (j * root) * (-(2 * j + 1) * x * y / l * now[s, s] - np.sqrt((j * j - x * x) * (j * j - y * y)) * last[s, s])
        k = np.arange(-l, l + 1)
        binomial = np.array([math.lgamma(2 * l + 1) - math.lgamma(l + i + 1) - math.lgamma(l - i + 1) for i in k])
        top = (-1.0) ** (l - k) * np.exp(binomial / 2 - l * math.log(2))  # row m = l
        s = slice(n - l, n + l + 1)
        if l == 1:
            new[n, n] = 0.0
        new[n + l, s] = top
        new[s, n + l] = (-1.0) ** (l - k) * top
        new[s, n - l] = top[::-1]
        new[n - l, s] = (-1.0) ** (l + k) * top[::-1]
        out.append(new[s, s].copy())
        last, now = now, new
    return out


def _euler(lst: np.ndarray, lat: float, az: np.ndarray, el: np.ndarray, selfrot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Angles a, b, c of Rz(a) Ry(b) Rz(c), which takes the beam's frame to the sky's; all given ones in degrees."""

    def rz(x):
        c, s, o = np.cos(x), np.sin(x), np.zeros_like(x)
        return np.stack([np.stack([c, -s, o], -1), np.stack([s, c, o], -1), np.stack([o, o, o + 1], -1)], -2)

    def ry(x):
        c, s, o = np.cos(x), np.sin(x), np.zeros_like(x)
        return np.stack([np.stack([c, o, s], -1), np.stack([o, o + 1, o], -1), np.stack([-s, o, c], -1)], -2)

    lst, az, el, selfrot = (np.radians(np.asarray(x, float)) for x in (lst, az, el, selfrot))
    r = rz(lst) @ ry(np.full_like(lst, np.pi / 2 - np.radians(lat))) @ rz(np.pi - az) @ ry(np.pi / 2 - el) @ rz(selfrot)
    flat = np.hypot(r[:, 0, 2], r[:, 1, 2]) < 1e-12
    b = np.arctan2(np.hypot(r[:, 0, 2], r[:, 1, 2]), r[:, 2, 2])
    a = np.where(flat, np.arctan2(r[:, 1, 0], r[:, 1, 1]), np.arctan2(r[:, 1, 2], r[:, 0, 2]))
    c = np.where(flat, 0.0, np.arctan2(r[:, 2, 1], -r[:, 2, 0]))
    return a, b, c


def _all_m(b: np.ndarray, lmax: int) -> list[np.ndarray]:
    """Of coefficients of m >= 0, one row for each channel, those of all m by l: (channels, 2l+1)."""
    out, at = [], _places(lmax)
    for l in range(lmax + 1):  # noqa: E741
        half = b[:, [at[l, m] for m in range(l + 1)]]
        sign = (-1.0) ** np.arange(l, 0, -1)
        out.append(np.concatenate([sign * half[:, :0:-1].conj(), half], axis=1))
    return out


def _places(lmax: int) -> dict[tuple[int, int], int]:
    pairs = ((l, m) for m in range(lmax + 1) for l in range(m, lmax + 1))
    return {p: i for i, p in enumerate(pairs)}


def rotated(b: list[np.ndarray], d: list[np.ndarray], angles: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """By l: (samples, channels, l+1) coefficients of m >= 0 of the beam turned by each sample's angles."""
    first, second, third = angles
    for l, (c, delta) in enumerate(zip(b, d)):
        m = np.arange(-l, l + 1)
        x = c[None] * np.exp(-1j * (third - np.pi / 2)[:, None, None] * m)
        x = (x @ delta) * np.exp(-1j * second[:, None, None] * m)
        yield l, (x @ delta.T)[:, :, l:] * np.exp(-1j * (first + np.pi / 2)[:, None, None] * m[l:])


# --- maps and coefficients -----------------------------------------------------
_COEFFS = "freq_idx int, l int, m int, re double, im double"


def analyse(maps: DataFrame, nside: int, lmax: int) -> DataFrame:
    """(freq_idx, l, m, re, im): sums over the pixels of a map (freq_idx, pix, value) times the harmonics' conjugates; no weight for a pixel's area.

    Pixels without a row, or of null value, count as zero; of repeated pixels all count. A pixel beyond 12 nside^2 is an error. A ring's pixels meet in one task,
    with all its channels; tasks hold their own sums alone.
    """
    _check(nside, lmax)

    def of(batches):
        total: dict[int, np.ndarray] = {}
        held = None

        def ring(part):
            at = int(part["ring"].iloc[0])
            z, size, start = ring_geometry(np.array([at]), nside)
            freqs, which = np.unique(part["freq_idx"].to_numpy(), return_inverse=True)
            phi = start[0] + 2 * np.pi * part["of"].to_numpy() / size[0]
            waves = np.zeros((len(freqs), lmax + 1), complex)
            for i in range(0, len(phi), 4096):
                s = slice(i, i + 4096)
                np.add.at(waves, which[s], part["value"].to_numpy()[s, None] * np.exp(-1j * phi[s, None] * np.arange(lmax + 1)))
            add = np.concatenate([legendre(z, m, lmax)[:, 0][None] * waves[:, m : m + 1] for m in range(lmax + 1)], axis=1)
            for f, x in zip(freqs.tolist(), add):
                total[f] = total.get(f, 0) + x

        for b in batches:
            b = b if held is None else pd.concat([held, b])
            ends = b["ring"].to_numpy() == b["ring"].iloc[-1] if len(b) else np.zeros(0, bool)
            held = b[ends]  # the last ring may go on
            for _, part in b[~ends].groupby("ring", sort=False):
                ring(part)
        if held is not None and len(held):
            ring(held)
        pairs = np.array(list(_places(lmax)), np.int32)
        for f, x in total.items():
            yield pd.DataFrame({"freq_idx": np.int32(f), "l": pairs[:, 0], "m": pairs[:, 1], "re": x.real, "im": x.imag})

    ring = ring_of(F.col("pix"), nside)
    rows = _pixels(maps, nside).withColumn("ring", ring).withColumn("of", F.col("pix") - ring_start(F.col("ring"), nside)).drop("pix")
    parts = rows.repartition("ring").sortWithinPartitions("ring", "freq_idx").mapInPandas(of, _COEFFS)
    return parts.groupBy("freq_idx", "l", "m").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def synthesise(coefficients: DataFrame, nside: int, lmax: int) -> DataFrame:
    """(freq_idx, pix, value) of all pixels of the channels of coefficients (freq_idx, l, m, re, im): the transpose of analyse() but for the weight two of m > 0,
    which stands for -m. Coefficients beyond lmax play no part."""
    _check(nside, lmax)
    rings = np.arange(1, 4 * nside)
    z, sizes, starts = ring_geometry(rings, nside)

    def by_mode(batches):
        for b in batches:
            for f, m, ls, re, im in zip(b["freq_idx"], b["m"], b["ls"], b["re"], b["im"]):
                of = legendre(z, m, lmax)[np.asarray(ls, int) - m]
                wave = (1 if m == 0 else 2) * (np.asarray(re) + 1j * np.asarray(im)) @ of
                yield pd.DataFrame({"freq_idx": np.int32(f), "ring": rings.astype(np.int32), "m": np.int32(m), "re": wave.real, "im": wave.imag})

    def by_ring(batches):
        for b in batches:
            for f, at, modes in zip(b["freq_idx"], b["ring"], b["modes"]):
                size, start = int(sizes[at - 1]), starts[at - 1]
                m = np.array([x["m"] for x in modes])
                wave = np.array([x["re"] + 1j * x["im"] for x in modes])
                folded = np.zeros(size, complex)  # modes of equal phase on this ring
                np.add.at(folded, m % size, wave * np.exp(1j * m * start))
                value = np.fft.ifft(folded).real * size
                first = 2 * at * (at - 1) if at < nside else 2 * nside * (nside - 1) + (at - nside) * 4 * nside if at <= 3 * nside else 12 * nside**2 - 2 * (4 * nside - at) * (4 * nside - at + 1)
                yield pd.DataFrame({"freq_idx": np.int32(f), "pix": np.arange(first, first + size, dtype=np.int64), "value": value})

    rows = coefficients.where((F.col("l") <= lmax) & (F.col("m") >= 0) & (F.col("m") <= F.col("l"))).groupBy("freq_idx", "m")
    rows = rows.agg(F.collect_list(F.struct("l", "re", "im")).alias("x")).select("freq_idx", "m", F.col("x.l").alias("ls"), F.col("x.re").alias("re"), F.col("x.im").alias("im"))
    waves = rows.mapInPandas(by_mode, "freq_idx int, ring int, m int, re double, im double")
    waves = waves.groupBy("freq_idx", "ring").agg(F.collect_list(F.struct("m", "re", "im")).alias("modes"))
    return waves.mapInPandas(by_ring, "freq_idx int, pix long, value double")


def beam_coefficients(beam: DataFrame, nside: int, lmax: int, turns: int = 3) -> DataFrame:
    """Coefficients of a beam map (freq_idx, pix, value) as a function on the sphere: analysis with the pixels' area, and `turns` times that of what its synthesis misses."""
    area = 4 * math.pi / (12 * nside**2)
    out = _scaled(analyse(beam, nside, lmax), area)
    for _ in range(turns):
        back = synthesise(out, nside, lmax).select("freq_idx", "pix", (-F.col("value")).alias("value"))
        rest = _scaled(analyse(beam.select("freq_idx", "pix", "value").unionByName(back), nside, lmax), area)
        out = out.unionByName(rest).groupBy("freq_idx", "l", "m").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return out


def _scaled(coefficients: DataFrame, by: float) -> DataFrame:
    return coefficients.select("freq_idx", "l", "m", (F.col("re") * by).alias("re"), (F.col("im") * by).alias("im"))


def zonal_beam(spark, shares: list[float], n_freq: int) -> DataFrame:
    """Coefficients of the beam sum over l of shares[l] P_l(cosine of the angle to its axis), the same for all channels."""
    rows = [(f, l, 0, c * math.sqrt(4 * math.pi / (2 * l + 1)), 0.0) for f in range(n_freq) for l, c in enumerate(shares)]
    return spark.createDataFrame(rows, _COEFFS)


# --- scans ---------------------------------------------------------------------
def _held(beam: DataFrame, lmax: int) -> list[tuple[list[int], np.ndarray]]:
    """Coefficients by channel, in passes of at most HELD_BYTES. Their number is that of channels times (lmax + 1)(lmax + 2) / 2, whatever the data."""
    at = _places(lmax)
    most = max(1, HELD_BYTES // (16 * len(at)))
    freqs = sorted(r[0] for r in beam.select("freq_idx").distinct().collect())
    out = []
    for i in range(0, len(freqs), most):
        some = freqs[i : i + most]
        b = np.zeros((len(some), len(at)), complex)
        for r in beam.where(F.col("freq_idx").isin(some) & (F.col("l") <= lmax)).select("freq_idx", "l", "m", "re", "im").collect():
            b[some.index(r.freq_idx), at[r.l, r.m]] += r.re + 1j * r.im
        out.append((some, b))
    return out


def _finite(pointing: DataFrame, *names: str) -> list[Column]:
    """The angles as doubles; one that is null or no number is an error, as an adjoint would pass over it in silence."""
    angle = lambda n: F.col(n).cast("double") if n in pointing.columns else F.lit(0.0)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return [F.when(odd(angle(n)), F.raise_error(F.lit(f"{n} isn't finite")).cast("double")).otherwise(angle(n)).alias(n) for n in names]


@dataclass(frozen=True)
class _Turner:
    """Turns beams to samples; goes to the tasks."""

    lat_deg: float
    nside: int
    lmax: int
    normalised: bool

    def weights(self) -> np.ndarray:
        return np.array([1.0 if m == 0 else 2.0 for _, m in _places(self.lmax)])

    def ones(self) -> np.ndarray:
        """Coefficients of the map that is one everywhere."""
        rings = np.arange(1, 4 * self.nside)
        z, sizes, starts = ring_geometry(rings, self.nside)
        of = lambda m: legendre(z, m, self.lmax) @ np.where(m % sizes == 0, sizes * np.exp(-1j * m * starts), 0)
        return np.concatenate([of(m) for m in range(self.lmax + 1)])

    def turn(self, b: np.ndarray, batches):
        """Parts of the batches, and the (samples, channels, coefficients) of the beam turned to each sample."""
        d, at, whole = right_angle(self.lmax), _places(self.lmax), _all_m(b, self.lmax)
        ones = self.weights() * self.ones().conj() if self.normalised else None
        step = max(1, (8 << 20) // (16 * b.size))
        for batch in batches:
            for i in range(0, len(batch), step):
                part = batch.iloc[i : i + step]
                out = np.zeros((len(part), *b.shape), complex)
                for l, x in rotated(whole, d, _euler(part["lst_deg"], self.lat_deg, part["az_deg"], part["el_deg"], part["selfrot_deg"])):
                    out[:, :, [at[l, m] for m in range(l + 1)]] = x
                yield part, out if ones is None else out / (out @ ones).real[:, :, None]


@dataclass(frozen=True)
class GeneralPointing:
    """Scans with a pointing of its own for each sample: a table (time_idx, lst_deg, az_deg, el_deg, and selfrot_deg if there is one).

    beam: coefficients (freq_idx, l, m, re, im) in its own frame, up to lmax. normalised: samples are divided by the turned beam's sum over the pixels.
    """

    beam: DataFrame
    lat_deg: float
    nside: int
    lmax: int
    normalised: bool = False

    def _turner(self) -> _Turner:
        return _Turner(self.lat_deg, self.nside, self.lmax, self.normalised)

    def _samples(self, pointing: DataFrame) -> DataFrame:
        return pointing.select("time_idx", *_finite(pointing, "lst_deg", "az_deg", "el_deg", "selfrot_deg"))

    def forward(self, sky: DataFrame, pointing: DataFrame) -> DataFrame:
        """(time_idx, freq_idx, value): sums over the pixels of the turned beam times the sky (freq_idx, pix, value)."""
        return self.forward_coefficients(analyse(sky, self.nside, self.lmax), pointing)

    def forward_coefficients(self, sky: DataFrame, pointing: DataFrame) -> DataFrame:
        """The same of a sky that is analysed already. Channels without a sky see zero."""
        turner, parts = self._turner(), []
        for some, b in _held(self.beam, self.lmax):
            a = np.zeros_like(b)
            for found, x in _held(sky.where(F.col("freq_idx").isin(some)), self.lmax):
                a[[some.index(f) for f in found]] = x

            def of(batches, some=some, b=b, w=a.conj() * turner.weights()):
                for part, turned in turner.turn(b, batches):
                    value = np.einsum("tfc,fc->tf", turned, w).real
                    yield pd.DataFrame({"time_idx": np.repeat(part["time_idx"].to_numpy(), len(some)), "freq_idx": np.tile(np.array(some, np.int32), len(part)), "value": value.ravel()})

            parts.append(self._samples(pointing).mapInPandas(of, f"time_idx {dict(pointing.dtypes)['time_idx']}, freq_idx int, value double"))
        return _union(parts)

    def adjoint_coefficients(self, cells: DataFrame, pointing: DataFrame) -> DataFrame:
        """Coefficients of the map that adjoint() returns."""
        turner, parts, pairs = self._turner(), [], np.array(list(_places(self.lmax)), np.int32)
        for some, b in _held(self.beam, self.lmax):

            def of(batches, some=some, b=b):
                total = np.zeros_like(b)
                for part, turned in turner.turn(b, batches):
                    value = np.zeros((len(part), len(some)))
                    for i, (fs, vs) in enumerate(zip(part["freqs"], part["values"])):
                        np.add.at(value[i], [some.index(f) for f in fs], vs)
                    total += np.einsum("tfc,tf->fc", turned, value)
                for f, x in zip(some, total):
                    yield pd.DataFrame({"freq_idx": np.int32(f), "l": pairs[:, 0], "m": pairs[:, 1], "re": x.real, "im": x.imag})

            kept = cells.where(F.col("freq_idx").isin(some) & F.col("value").isNotNull())
            lists = kept.groupBy("time_idx").agg(F.collect_list(F.struct(F.col("freq_idx").cast("int").alias("f"), F.col("value").cast("double").alias("v"))).alias("x"))
            lists = lists.select("time_idx", F.col("x.f").alias("freqs"), F.col("x.v").alias("values"))
            parts.append(self._samples(pointing).join(lists, "time_idx").mapInPandas(of, _COEFFS))
        return _union(parts).groupBy("freq_idx", "l", "m").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))

    def adjoint(self, cells: DataFrame, pointing: DataFrame) -> DataFrame:
        """(freq_idx, pix, value): sums over the samples of the turned beam times cells (time_idx, freq_idx, value); the transpose of forward()."""
        return synthesise(self.adjoint_coefficients(cells, pointing), self.nside, self.lmax)


def _union(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ParameterError("the beam has no coefficients")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@dataclass(frozen=True)
class DriftScan:
    """Scans whose pointing stays: only lst_deg of the times (time_idx, lst_deg) moves. What GeneralPointing gives for such samples, at the price of one turn.

    beam: coefficients in its own frame; or, with referenced, those that reference() returned for the same lst_ref_deg.
    """

    beam: DataFrame
    lat_deg: float
    az_deg: float
    el_deg: float
    nside: int
    lmax: int
    selfrot_deg: float = 0.0
    lst_ref_deg: float = 0.0
    normalised: bool = False
    referenced: bool = False

    def reference(self) -> DataFrame:
        """Coefficients of the beam in the sky's frame at lst_ref_deg: a channel is turned in one task, of (lmax + 1)(lmax + 2) / 2 numbers."""
        if self.referenced:
            return self.beam
        turner = _Turner(self.lat_deg, self.nside, self.lmax, False)
        at = pd.DataFrame({"lst_deg": [self.lst_ref_deg], "az_deg": [self.az_deg], "el_deg": [self.el_deg], "selfrot_deg": [self.selfrot_deg]})
        places = _places(self.lmax)
        pairs = np.array(list(places), np.int32)

        def of(part: pd.DataFrame) -> pd.DataFrame:
            b = np.zeros((1, len(places)), complex)
            for l, m, re, im in zip(part["l"], part["m"], part["re"], part["im"]):
                b[0, places[l, m]] += re + 1j * im
            ((_, x),) = turner.turn(b, [at])
            return pd.DataFrame({"freq_idx": part["freq_idx"].iloc[0], "l": pairs[:, 0], "m": pairs[:, 1], "re": x[0, 0].real, "im": x[0, 0].imag})

        return self.beam.where((F.col("l") <= self.lmax) & (F.col("m") <= F.col("l")) & (F.col("m") >= 0)).groupBy("freq_idx").applyInPandas(of, _COEFFS)

    def mmodes(self, sky: DataFrame) -> DataFrame:
        """(freq_idx, m, re, im) of the signal: the sky (freq_idx, pix, value) seen by the beam."""
        return self.mmodes_of(analyse(sky, self.nside, self.lmax))

    def mmodes_of(self, coefficients: DataFrame) -> DataFrame:
        b = self.reference().select("freq_idx", "l", "m", F.col("re").alias("br"), F.col("im").alias("bi"))
        met = b.join(coefficients.select("freq_idx", "l", "m", "re", "im"), ["freq_idx", "l", "m"])
        re, im = F.col("br") * F.col("re") + F.col("bi") * F.col("im"), F.col("bi") * F.col("re") - F.col("br") * F.col("im")
        return met.groupBy("freq_idx", "m").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))

    def _times(self, times: DataFrame) -> DataFrame:
        return times.select("time_idx", *_finite(times, "lst_deg"))

    def _divisors(self, times: DataFrame) -> DataFrame:
        """(time_idx, freq_idx, divisor): the turned beam's sum over the pixels."""
        ones = _Turner(self.lat_deg, self.nside, self.lmax, False).ones()
        rows = [(*p, float(x.real), float(x.imag)) for p, x in zip(_places(self.lmax), ones)]
        known = times.sparkSession.createDataFrame(rows, "l int, m int, re double, im double")
        each = known.join(self.beam.select("freq_idx", "l").distinct(), "l")
        return mmode_synthesis(self.mmodes_of(each), self._times(times), self.lst_ref_deg).withColumnRenamed("value", "divisor")

    def forward(self, sky: DataFrame, times: DataFrame) -> DataFrame:
        """(time_idx, freq_idx, value): sums over the pixels of the turned beam times the sky (freq_idx, pix, value)."""
        return self.forward_coefficients(analyse(sky, self.nside, self.lmax), times)

    def forward_coefficients(self, sky: DataFrame, times: DataFrame) -> DataFrame:
        """The same of a sky that is analysed already."""
        out = mmode_synthesis(self.mmodes_of(sky), self._times(times), self.lst_ref_deg)
        if not self.normalised:
            return out
        return out.join(self._divisors(times), ["time_idx", "freq_idx"]).select("time_idx", "freq_idx", (F.col("value") / F.col("divisor")).alias("value"))

    def adjoint_coefficients(self, cells: DataFrame, times: DataFrame) -> DataFrame:
        """Coefficients of the map that adjoint() returns: the beam's, times the waves that the samples hold."""
        if self.normalised:
            cells = cells.join(self._divisors(times), ["time_idx", "freq_idx"]).withColumn("value", F.col("value") / F.col("divisor"))
        lmax, ref = self.lmax, self.lst_ref_deg

        def of(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for i in range(0, len(b), 4096):
                    part = b.iloc[i : i + 4096]
                    wave = part["value"].to_numpy()[:, None] * np.exp(-1j * np.radians(part["lst_deg"].to_numpy() - ref)[:, None] * np.arange(lmax + 1))
                    for f, rows in part.groupby("freq_idx").indices.items():
                        total[f] = total.get(f, 0) + wave[rows].sum(axis=0)
            for f, x in total.items():
                yield pd.DataFrame({"freq_idx": np.int32(f), "m": np.arange(lmax + 1, dtype=np.int32), "wr": x.real, "wi": x.imag})

        met = cells.where(F.col("value").isNotNull()).select("time_idx", F.col("freq_idx").cast("int").alias("freq_idx"), F.col("value").cast("double").alias("value")).join(self._times(times), "time_idx")
        waves = met.mapInPandas(of, "freq_idx int, m int, wr double, wi double").groupBy("freq_idx", "m").agg(F.sum("wr").alias("wr"), F.sum("wi").alias("wi"))
        both = self.reference().join(waves, ["freq_idx", "m"])
        re, im = F.col("re") * F.col("wr") - F.col("im") * F.col("wi"), F.col("re") * F.col("wi") + F.col("im") * F.col("wr")
        return both.select("freq_idx", "l", "m", re.alias("re"), im.alias("im"))

    def adjoint(self, cells: DataFrame, times: DataFrame) -> DataFrame:
        """(freq_idx, pix, value): sums over the samples of the turned beam times cells (time_idx, freq_idx, value); the transpose of forward()."""
        return synthesise(self.adjoint_coefficients(cells, times), self.nside, self.lmax)
