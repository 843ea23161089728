"""Student t tails and quantiles, binomial and chi-square tails: column expressions over a few comparison rows.

Tails are worked out as tails, never as one minus the centre, so small probabilities keep their digits. The t tail is the
regularised incomplete beta function by its continued fraction (DLMF 8.17.22), for any positive degrees of freedom. The
quantile is a bisection on it over the logarithm of t, which has no end that a table could reach.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_BISECTIONS = 64
_LOG_T = (-340.0, 345.0)  # t * t stays a finite number above zero between these
_SHIFT = 12  # steps that bring an argument into the range of the asymptotic series


def _log_half_step(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)): the asymptotic series (DLMF 5.11.13) at a + 12, brought back by the recurrence."""
    z = a + _SHIFT
    # Coefficients of 1/z, 1/z^3, 1/z^5, 1/z^7, 1/z^9.
    series = -1 / (8 * z) + 1 / (192 * z**3) - 1 / (640 * z**5) + 17 / (14336 * z**7) - 31 / (18432 * z**9)
    back = sum((F.log1p(0.5 / (a + j)) for j in range(_SHIFT)), F.lit(0.0))
    return 0.5 * F.ln(z) + series - back


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """1 / (1 + d1 / (1 + d2 / ...)) from the last term back; the terms needed grow with the root of the larger parameter."""

    def term(j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(j % 2 == 0, even).otherwise(odd)

    last = (80 + 8 * F.sqrt(F.greatest(a, b))).cast("int")
    return F.aggregate(F.sequence(last, F.lit(1), F.lit(-1)), F.lit(1.0), lambda f, j: 1 / f * term(j) + 1, lambda f: 1 / f)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _tail_and_centre(t: Column, df: Column) -> Column:
    """A struct of P(|T| > t) and P(|T| <= t) for t > 0, each with its own leading digits."""
    half = F.lit(0.5)

    def parts(v):
        a, square = v["a"], v["square"]  # square is t * t / df, x = 1 / (1 + square), y = 1 - x
        y = 1 / (1 + 1 / square)
        log_x, log_y = -F.log1p(square), -F.log1p(1 / square)
        front = F.exp(_log_half_step(a) - 0.5 * math.log(math.pi) + a * log_x + 0.5 * log_y)
        far = y > 1.5 / (a + 2.5)  # where the fraction in x converges fast
        part = F.when(far, front / a * _beta_fraction(a, half, F.exp(log_x))).otherwise(front / half * _beta_fraction(half, a, y))
        return F.struct(far.alias("far"), part.alias("part"))

    def whole(v):
        far, part = v["far"], v["part"]
        return F.struct(F.when(far, part).otherwise(1 - part).alias("tail"), F.when(far, 1 - part).otherwise(part).alias("centre"))

    given = F.struct(df.cast("double").alias("df"), (t / F.sqrt(df.cast("double"))).alias("ratio"))
    scaled = _let(given, lambda v: F.struct((v["df"] / 2).alias("a"), (v["ratio"] * v["ratio"]).alias("square")))
    return _let(_let(scaled, parts), whole)


def _valid(df: Column) -> Column:
    df = df.cast("double")
    return F.when(df > 0, df)  # no distribution otherwise: NULL


def central(t: Column, df: Column) -> Column:
    """P(|T| <= t) for t >= 0 and df > 0, whole or not; NULL for other df."""
    df = _valid(df)
    centre = _tail_and_centre(F.greatest(t, F.lit(math.exp(_LOG_T[0]))), df)["centre"]
    return F.when(df.isNull() | t.isNull() | F.isnan(t), F.lit(None)).when(t == 0, 0.0).when(t > math.exp(_LOG_T[1]), 1.0).otherwise(centre)


def two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| > |t|)."""
    df, t = _valid(df), F.abs(t)
    tail = _tail_and_centre(F.greatest(t, F.lit(math.exp(_LOG_T[0]))), df)["tail"]
    return F.when(df.isNull() | t.isNull() | F.isnan(t), F.lit(None)).when(t == 0, 1.0).when(t > math.exp(_LOG_T[1]), 0.0).otherwise(tail)


def upper_tail(t: Column, df: Column) -> Column:
    """P(T > t)."""
    half = two_sided_p(t, df) / 2
    return F.when(t >= 0, half).otherwise(1 - half)


def quantile(p: float, df: Column) -> Column:
    """t with P(T <= t) = p, for 0.5 <= p < 1."""
    if not 0.5 <= p < 1.0:
        raise ValueError("p must be in [0.5, 1)")
    if p == 0.5:
        return F.when(_valid(df).isNotNull(), F.lit(0.0))
    df, target = _valid(df), 2 * (1 - p)
    start = F.struct(F.lit(_LOG_T[0]).alias("lo"), F.lit(_LOG_T[1]).alias("hi"))

    def step(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        above = _tail_and_centre(F.exp(mid), df)["tail"] > target
        return F.struct(F.when(above, mid).otherwise(acc["lo"]).alias("lo"), F.when(above, acc["hi"]).otherwise(mid).alias("hi"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(_BISECTIONS)), start, step, lambda a: F.exp((a["lo"] + a["hi"]) / 2))
    return F.when(df.isNotNull(), root)


def binomial_two_sided(k: Column, n: Column) -> Column:
    """min(1, 2 * P(X <= k)) for X binomial with n trials at one half and k at most n / 2, for any n.

    The largest term is held as a logarithm, the sum relative to it, so nothing overflows or vanishes.
    """
    n, k = n.cast("double"), k.cast("int")
    start = F.struct(F.lit(0.0).alias("log_term"), F.lit(1.0).alias("sum"))

    def step(acc, i):
        ratio = (n - i + 1) / i
        return F.struct((acc["log_term"] + F.ln(ratio)).alias("log_term"), (1.0 + acc["sum"] / ratio).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    log_tail = F.aggregate(steps, start, step, lambda a: a["log_term"] + F.ln(a["sum"]))
    return F.least(F.lit(1.0), 2 * F.exp(log_tail - n * math.log(2.0)))


def chi2_1_upper(x: Column) -> Column:
    """P(X > x) for chi-square with one degree of freedom: the complementary error function of the root of x / 2.

    A sum of positive terms near zero, a continued fraction beyond 2 (DLMF 7.6.2, 7.9.2), so the tail keeps its digits.
    """
    x = x.cast("double")
    z = F.sqrt(F.greatest(x, F.lit(0.0)) / 2)
    zero = F.struct(z.alias("term"), z.alias("sum"))

    def step(acc, j):
        term = acc["term"] * 2 * z * z / (2 * j + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    near = F.aggregate(F.sequence(F.lit(1), F.lit(60)), zero, step, lambda a: a["sum"])
    far = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), z, lambda f, j: z + j / 2 / f)
    scale = F.exp(-z * z) / math.sqrt(math.pi)
    return F.when(x.isNull() | F.isnan(x), F.lit(None)).when(z < 2, 1 - 2 * scale * near).otherwise(scale / far)
