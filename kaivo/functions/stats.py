"""Interval and test statistics as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963985
#: Sum of 1/j^2 over all j, to which repeated occurrences of one lexeme converge; positions of a lexeme that count.
ZETA2, MOST_POSITIONS = 1.64493406685, 255


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Ends of the Wilson score interval; null if n is 0 (undefined isn't zero)."""
    s, m = successes.cast("double"), F.when(n > 0, n.cast("double"))
    p = s / m
    denominator = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / denominator
    spread = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / denominator
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - spread)), F.when(n > 0, F.least(F.lit(1.0), centre + spread))


def mcnemar(a: Column, b: Column) -> Column:
    """Exact two-sided p of a : b discordant pairs: binomial terms by recurrence, of their logarithms where 0.5^n would underflow."""
    n, k = (a + b).cast("int"), F.least(a, b).cast("int")
    steps = F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))

    def tail(first: Column, term: Callable[[Column, Column], Column], value: Callable[[Column], Column]) -> Column:
        def step(acc: Column, i: Column) -> Column:
            now = term(acc["term"], (n - i + 1) / i)
            return F.struct(now.alias("term"), (acc["sum"] + value(now)).alias("sum"))

        return F.aggregate(steps, F.struct(first.alias("term"), value(first).alias("sum")), step, lambda acc: acc["sum"])

    plain = tail(F.pow(F.lit(0.5), n.cast("double")), lambda x, ratio: x * ratio, lambda x: x)
    logs = tail(n.cast("double") * math.log(0.5), lambda x, ratio: x + F.log(ratio), F.exp)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.when(n <= 1000, plain).otherwise(logs)))


def h2(tf: Column) -> Column:
    """Sum of 1/j^2 for j to tf (at most MOST_POSITIONS): what tf occurrences weigh."""
    table, total = [], 0.0
    for j in range(1, MOST_POSITIONS + 1):
        total += 1.0 / (j * j)
        table.append(F.lit(total))
    return F.element_at(F.array(*table), F.least(tf, F.lit(MOST_POSITIONS)).cast("int"))


def length_divisor(normalisation: Column, length: Column) -> Column:
    """0: none; 1: log2(length + 1); 2: the length (in index positions)."""
    return F.when(normalisation == 1, F.log2(length + 1)).when(normalisation == 2, length.cast("double")).otherwise(F.lit(1.0))
