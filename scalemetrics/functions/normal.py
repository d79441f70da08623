"""Standard normal distribution function as a Column expression.

Spark has no ``erf``.  The rational approximation below (Hart 1968, as given by
West 2005) is accurate to about 1e-15 and stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published coefficients, highest power first.
NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
TAIL_FROM = 7.07106781186547
SQRT_2PI = 2.506628274631


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


def normal_cdf(z: Column) -> Column:
    """P(Z <= z).  ``z`` is repeated, so pass a column rather than a long expression."""
    return upper_to_cdf(z, upper_tail(F.least(F.abs(z), F.lit(37.0))))


def upper_tail(a: Column) -> Column:
    """P(Z > a) for 0 <= a <= 37."""
    density = F.exp(-a * a / 2.0)
    fraction = a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))
    near = _horner(a, NUMERATOR) / _horner(a, DENOMINATOR)
    return density * F.when(a < TAIL_FROM, near).otherwise(1.0 / (fraction * SQRT_2PI))


def upper_to_cdf(z: Column, upper: Column) -> Column:
    return F.when(z > 0, 1.0 - upper).otherwise(upper)


def with_normal_cdf(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add P(Z <= z) columns; ``columns`` maps target -> column holding z.

    |z| and the tail are projected on the way so that the generated code holds
    every polynomial once.
    """
    out = df.withColumns({f"__a_{t}": F.least(F.abs(z), F.lit(37.0)) for t, z in columns.items()})
    out = out.withColumns({f"__u_{t}": upper_tail(F.col(f"__a_{t}")) for t in columns})
    out = out.withColumns({t: F.when(F.col(z).isNotNull(), upper_to_cdf(F.col(z), F.col(f"__u_{t}"))) for t, z in columns.items()})
    return out.drop(*[f"__{p}_{t}" for t in columns for p in "au"])


def normal_cdf_array(z: np.ndarray) -> np.ndarray:
    """The same function for arrays inside a task."""
    a = np.minimum(np.abs(z), 37.0)
    fraction = a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))
    upper = np.exp(-a * a / 2.0) * np.where(a < TAIL_FROM, np.polyval(NUMERATOR, a) / np.polyval(DENOMINATOR, a), 1.0 / (fraction * SQRT_2PI))
    return np.where(z > 0, 1.0 - upper, upper)
