"""Spread rates of fuels as column expressions, and codes of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..grid import HEAT


def decode_fuel(layer: Column) -> Column:
    """The nearest code, 0 outside of 1..13."""
    code = F.floor(layer + 0.5).cast("int")
    return F.when(code.between(1, 13), code).otherwise(0)


def damping(moisture: Column, extinction: Column) -> Column:
    x = moisture / extinction
    return F.when((extinction <= 0) | (moisture >= extinction), 0.0).otherwise(1 - 2.59 * x + 5.11 * x * x - 3.52 * x * x * x)


def _rate(density: Column, intensity_of_damp: Column, wind: Column, slope: Column, moisture: Column) -> Column:
    sv = F.col("sv")
    packing, best = density / 32, 3.348 * F.pow(sv, F.lit(-0.8189))
    ratio = packing / best
    a = 133 * F.pow(sv, F.lit(-0.7913))
    most = F.pow(sv, F.lit(1.5)) / (495 + 0.594 * F.pow(sv, F.lit(1.5)))
    intensity = most * F.pow(ratio, a) * F.exp(a * (1 - ratio)) * F.col("w1") * HEAT * intensity_of_damp * 0.417439
    flux = F.exp((0.792 + 0.681 * F.sqrt(sv)) * (packing + 0.1)) / (192 + 0.2595 * sv)
    c, b, e = 7.47 * F.exp(-0.133 * F.pow(sv, F.lit(0.55))), 0.02526 * F.pow(sv, F.lit(0.54)), 0.715 * F.exp(-3.59e-4 * sv)
    by_wind = c * F.pow(wind * 196.85 + 1, b) * F.pow(ratio, -e)
    by_slope = 5.275 * F.pow(ratio, F.lit(-0.3)) * F.pow(slope / 100, F.lit(2.0))
    sink = density * (250 + 1116 * moisture)
    return F.when((sv <= 0) | (best <= 0) | (F.col("delta") <= 0) | (sink <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), intensity * flux * (1 + by_wind + by_slope) / sink * 0.00508))


def full_rate(wind: Column, slope: Column, moisture: Column) -> Column:
    """Rate over the columns of the fuel table, all loads and damping."""
    return _rate((F.col("w1") + F.col("w10") + F.col("w100") + F.col("wherb")) / F.col("delta"), damping(moisture, F.col("mx")), wind, slope, moisture)


def reduced_rate(wind: Column, slope: Column) -> Column:
    """Only the 1 h load, without damping, at a moisture of 0.05."""
    return _rate(F.col("w1") / F.col("delta"), F.lit(1.0), wind, slope, F.lit(0.05))


def directional(rate: Column, bearing: Column, wind_to: Column, share: float = 0.5, floor: float = 0.01) -> Column:
    """share is the anisotropy; with 1 and a floor of 0.001 this is the other form of the rule."""
    return F.greatest(F.lit(floor), rate * (1 + share * F.cos(F.radians(wind_to - bearing))) / (1 + share))


#: The rate in SQL over the fuel table; {density}, {damp}, {wind}, {slope} and {moisture} are filled in.
SQL_RATE = """CASE WHEN sv <= 0 OR delta <= 0 THEN 0e0 ELSE greatest(0e0,
  pow(sv, 15e-1) / (495e0 + 0.594e0 * pow(sv, 15e-1)) * pow(({density}) / 32e0 / (3.348e0 * pow(sv, -0.8189e0)), 133e0 * pow(sv, -0.7913e0))
  * exp(133e0 * pow(sv, -0.7913e0) * (1e0 - ({density}) / 32e0 / (3.348e0 * pow(sv, -0.8189e0)))) * w1 * 18622e0 * ({damp}) * 0.417439e0
  * exp((0.792e0 + 0.681e0 * sqrt(sv)) * (({density}) / 32e0 + 0.1e0)) / (192e0 + 0.2595e0 * sv)
  * (1e0 + 7.47e0 * exp(-0.133e0 * pow(sv, 0.55e0)) * pow({wind} * 196.85e0 + 1e0, 0.02526e0 * pow(sv, 0.54e0)) * pow(({density}) / 32e0 / (3.348e0 * pow(sv, -0.8189e0)), -0.715e0 * exp(-3.59e-4 * sv))
     + 5.275e0 * pow(({density}) / 32e0 / (3.348e0 * pow(sv, -0.8189e0)), -0.3e0) * pow({slope} / 100e0, 2e0))
  / (({density}) * (250e0 + 1116e0 * {moisture})) * 0.00508e0) END"""
SQL_DAMP = "CASE WHEN mx <= 0 OR {m} >= mx THEN 0e0 ELSE 1e0 - 2.59e0 * ({m} / mx) + 5.11e0 * ({m} / mx) * ({m} / mx) - 3.52e0 * ({m} / mx) * ({m} / mx) * ({m} / mx) END"
