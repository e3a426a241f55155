"""Scalar expressions on angles, positions and scores. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_angle(a: Column) -> Column:
    """To [-180, 180), with a floor modulus, so negatives wrap too."""
    return F.pmod(a + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def bearing(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def horizontal(dx: Column, dy: Column) -> Column:
    """Ground distance, 1 at least, so that nothing is divided by 0."""
    return F.greatest(F.hypot(dx, dy), F.lit(1.0))


def elevation(dz: Column, h: Column) -> Column:
    """Positive looks down."""
    return -F.degrees(F.atan2(dz, h))


def eye_height(z: Column, duck: Column) -> Column:
    return z + F.lit(64.0) - F.lit(18.0) * duck


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))


def signed_asinh(x: Column, scale: Column | float = 1.0) -> Column:
    """asinh of x / scale by its size; the function itself loses digits below 0."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.signum(x) * F.asinh(F.abs(x) / s)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def expit(z: Column, limit: float = 40.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clamp(z, -limit, limit)))


def platt(p: Column, slope: float, offset: float, eps: float = 1e-6) -> Column:
    return expit(F.lit(slope) * logit(p, eps) + F.lit(offset))


def blend(weights: dict[str, float], in_logit: bool = False) -> Column:
    """Weighted mean of score columns, of probabilities or of their logits."""
    total = sum(weights.values())
    parts = [F.lit(w / total) * (logit(F.col(c)) if in_logit else F.col(c)) for c, w in weights.items()]
    mixed = sum(parts[1:], parts[0])
    return expit(mixed) if in_logit else mixed


def finite_or_zero(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 0.0).otherwise(x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def on_ground(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(1)) == 1


def salted_id(identity: Column, salt: str, digits: int = 8) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), identity), 256), 1, digits)


def plain_name(name: Column) -> Column:
    """Letters and digits in lower case, without a leading member prefix."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, "^m_", "")), "[^a-z0-9]", "")


def valid_identity(identity: Column) -> Column:
    return ~F.lower(F.trim(identity)).isin("", "0", "0.0", "nan", "none", "<na>") & identity.isNotNull()


def player_id(steamid: Column, slot: Column, bots: bool = False) -> Column:
    """The id as text; bots (id 0) by their slot where asked for, else null."""
    named = F.when(steamid != 0, steamid.cast("string"))
    return named.otherwise(F.concat(F.lit("bot:"), slot.cast("string"))) if bots else named
