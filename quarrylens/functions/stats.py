"""Statistical expressions for mining: Poisson tails and Chernoff bounds as plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def poisson_at_most(observed: Column, expected: Column) -> Column:
    """P(X <= observed) for a Poisson variable: a fold over the terms."""
    first = F.struct(F.exp(-expected).alias("term"), F.exp(-expected).alias("total"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * expected / k
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    terms = F.when(observed >= 1, F.sequence(F.lit(1), observed.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, first, step, lambda acc: acc["total"])


def avoids(observed: Column, expected: Column, share: float = 0.2, bound: float = 0.001) -> Column:
    """Seen far less often than expected, and not by chance."""
    return (expected > 0) & (observed <= share * expected) & (poisson_at_most(observed, expected) <= bound)


def surprise_above(count: Column, expected: Column) -> Column:
    """-log10 of the Chernoff bound on P(X >= count), 0 at or below the expectation."""
    return F.when(count > expected, (count * F.log(count / expected) - (count - expected)) / F.log(F.lit(10.0))).otherwise(F.lit(0.0))


def surprise_below(count: Column, expected: Column) -> Column:
    """-log10 of the Chernoff bound on P(X <= count), 0 at or above the expectation."""
    inner = F.when(count > 0, count * F.log(count / expected)).otherwise(F.lit(0.0)) - (count - expected)
    return F.when(count < expected, inner / F.log(F.lit(10.0))).otherwise(F.lit(0.0))


def divergence(q: Column, p: Column) -> Column:
    """Kullback-Leibler divergence of two Bernoulli shares."""
    a = F.when(q > 0, q * F.log(q / p)).otherwise(F.lit(0.0))
    b = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(F.lit(0.0))
    return a + b


def surprise_share(n: Column, q: Column, p: Column) -> Column:
    """-log10 of the Chernoff bound on a share q or more among n at a base share p."""
    return F.when(q > p, n * divergence(q, p) / F.log(F.lit(10.0))).otherwise(F.lit(0.0))
