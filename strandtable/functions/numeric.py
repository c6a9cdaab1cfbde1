"""Distribution functions as Columns: they act on grouped rows and stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients (g = 7) and the Chebyshev fit of erfc (fractional error 1.2e-7).
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def lgamma(x: Column) -> Column:
    """Log-gamma of numbers of at least 0.5."""
    def at(y: Column) -> Column:
        total = F.lit(LANCZOS[0])
        for k, c in enumerate(LANCZOS[1:], 1):
            total = total + F.lit(c) / (y + k)
        return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.log(y + 7.5) - (y + 7.5) + F.log(total)

    return let(x.cast("double") - 1, at)


def digamma(x: Column) -> Column:
    """Derivative of log-gamma for positive numbers: shifted by 8, then the asymptotic series."""
    def at(v: Column) -> Column:
        y = v + 8
        low = sum((1 / (v + k) for k in range(8)), F.lit(0.0))
        q = 1 / (y * y)
        return F.log(y) - 0.5 / y - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q / 240))) - low

    return let(x.cast("double"), at)


def trigamma(x: Column) -> Column:
    def at(v: Column) -> Column:
        y = v + 8
        low = sum((1 / ((v + k) * (v + k)) for k in range(8)), F.lit(0.0))
        q = 1 / (y * y)
        return 1 / y + q / 2 + q / y * (1 / 6 - q * (1 / 30 - q * (1 / 42 - q / 30))) + low

    return let(x.cast("double"), at)


def erfc(x: Column) -> Column:
    """Complementary error function, accurate in the tails as well."""
    def at(s: Column) -> Column:
        poly = F.lit(ERFC[-1])
        for c in ERFC[-2::-1]:
            poly = poly * s["t"] + c
        return s["t"] * F.exp(-s["z"] * s["z"] + poly)

    z = F.abs(x.cast("double"))
    y = let(let(z, lambda v: F.struct(v.alias("z"), (1 / (1 + 0.5 * v)).alias("t"))), at)
    return F.when(x >= 0, y).when(x < 0, 2 - y)


def normal_two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), erfc(F.abs(z) / math.sqrt(2)))


def log_choose(n: Column, k: Column) -> Column:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def hypergeometric_sf(k: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= k) for ``drawn`` from ``population`` of which ``marked`` count."""
    top = F.least(marked, drawn)
    whole = log_choose(population, drawn)
    low = F.greatest(k, drawn + marked - population, F.lit(0)).cast("long")
    pmf = lambda i: F.exp(log_choose(marked, i) + log_choose(population - marked, drawn - i) - whole)
    tail = F.aggregate(F.sequence(low, top.cast("long")), F.lit(0.0), lambda acc, i: acc + pmf(i))
    return F.when(low > top, 0.0).otherwise(F.least(F.lit(1.0), tail))


def fisher_two_sided(k: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """Sum of the probabilities of all tables that are no likelier than the one seen."""
    whole = log_choose(population, drawn)
    pmf = lambda i: log_choose(marked, i) + log_choose(population - marked, drawn - i) - whole
    span = F.sequence(F.greatest(F.lit(0), drawn + marked - population).cast("long"), F.least(marked, drawn).cast("long"))
    total = F.aggregate(span, F.lit(0.0), lambda acc, i: acc + F.when(pmf(i) <= pmf(k) + 1e-7, F.exp(pmf(i))).otherwise(0.0))
    return F.least(F.lit(1.0), total)


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of chi-square with whole degrees of freedom, in closed form."""
    h, odd = x / 2, df % 2 == 1
    terms = F.when(df < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (F.floor(df / 2) - 1).cast("int")))
    shift = F.when(odd, 0.5).otherwise(0.0)
    term = lambda i: F.exp(-h + (i + shift) * F.log(h) - lgamma(i + 1 + shift))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, i: acc + term(i))
    return F.when(x <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.when(odd, erfc(F.sqrt(h))).otherwise(0.0) + total))


def beta_inc(x: Column, a: Column, b: Column, steps: int = 120) -> Column:
    """Regularised incomplete beta function by a continued fraction of fixed length."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    tiny = 1e-300
    guard = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def fraction(x: Column, a: Column, b: Column) -> Column:
        def step(s: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            one = lambda e, t: F.struct(guard(1 + e / t["c"]).alias("c"), (1 / guard(1 + e * t["d"])).alias("d"), t["h"].alias("h"))
            grown = lambda t: F.struct(t["c"], t["d"], (t["h"] * t["c"] * t["d"]).alias("h"))
            return let(let(let(one(even, s), grown), lambda t: one(odd, t)), grown)

        first = 1 / guard(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["h"]

    front = F.exp(lgamma(a + b + 1) - F.log(a + b) - lgamma(a + 1) + F.log(a) - lgamma(b + 1) + F.log(b) + a * F.log(x) + b * F.log1p(-x))
    low = front * fraction(x, a, b) / a
    high = 1 - front * fraction(1 - x, b, a) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def t_two_sided(t: Column, df: Column) -> Column:
    x = let(F.struct(t.cast("double").alias("t"), df.cast("double").alias("n")), lambda s: F.struct((s["n"] / (s["n"] + s["t"] * s["t"])).alias("x"), (s["n"] / 2).alias("a")))
    return let(x, lambda s: beta_inc(s["x"], s["a"], F.lit(0.5)))


def log2(x: Column) -> Column:
    return F.log(x) / math.log(2)


# The same erfc for SQL: %s stands for a non-negative argument.
def sql_erfc(z: str) -> str:
    t = f"(1/(1+0.5*({z})))"
    poly = str(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = f"({poly})*{t}+({c})"
    return f"({t}*exp(-({z})*({z})+({poly})))"
