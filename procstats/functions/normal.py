"""Standard normal cdf and quantile as plain column expressions.

Both stay inside whole-stage codegen, so row-level users (probability plots,
goodness-of-fit statistics) need no Python worker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hart's rational approximation of the normal tail (double precision).
HART_NUMERATOR = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
HART_DENOMINATOR = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
# Wichura's algorithm AS 241 (PPND16), constant term first.
CENTRAL_NUMERATOR = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
    3.3430575583588128105e4, 2.5090809287301226727e3,
]
CENTRAL_DENOMINATOR = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
    5.2264952788528545610e3,
]
MIDDLE_NUMERATOR = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
    3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
    2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
MIDDLE_DENOMINATOR = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
    1.05075007164441684324e-9,
]
TAIL_NUMERATOR = [
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
    2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
    2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
TAIL_DENOMINATOR = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
    2.04426310338993978564e-15,
]


def _poly(x: Column, high_first: list[float]) -> Column:
    acc = F.lit(high_first[0])
    for a in high_first[1:]:
        acc = acc * x + F.lit(a)
    return acc


def norm_cdf(z: Column) -> Column:
    """Pass a plain column: the argument is repeated in both polynomials."""
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    body = e * _poly(a, HART_NUMERATOR) / _poly(a, HART_DENOMINATOR)
    frac = a + F.lit(1.0) / (a + F.lit(2.0) / (a + F.lit(3.0) / (a + F.lit(4.0) / (a + 0.65))))
    tail = F.when(a < 7.07106781186547, body).when(a <= 37, e / frac / math.sqrt(2 * math.pi)).otherwise(0.0)
    return F.when(z.isNull(), None).when(z > 0, 1 - tail).otherwise(tail)


def norm_sf(z: Column) -> Column:
    return norm_cdf(-z)


def with_norm_ppf(df: DataFrame, name: str, p: Column) -> DataFrame:
    """Add the normal quantile of `p` (NULL outside (0, 1)).

    The shared parts are columns of their own: nesting them would repeat them in
    every polynomial and outgrow the generated-code limit.
    """
    df = df.withColumn("_pp", p)
    pp = F.col("_pp")
    df = df.withColumn("_pq", pp - 0.5).withColumn("_ps", F.sqrt(-F.ln(F.least(pp, 1 - pp))))
    df = df.withColumn("_pr", F.when(F.abs("_pq") <= 0.425, F.lit(0.180625) - F.col("_pq") * F.col("_pq"))
                       .when(F.col("_ps") <= 5.0, F.col("_ps") - 1.6).otherwise(F.col("_ps") - 5.0))
    q, s, r = F.col("_pq"), F.col("_ps"), F.col("_pr")
    central = q * _poly(r, CENTRAL_NUMERATOR[::-1]) / _poly(r, CENTRAL_DENOMINATOR[::-1])
    middle = _poly(r, MIDDLE_NUMERATOR[::-1]) / _poly(r, MIDDLE_DENOMINATOR[::-1])
    far = _poly(r, TAIL_NUMERATOR[::-1]) / _poly(r, TAIL_DENOMINATOR[::-1])
    value = (F.when((pp <= 0) | (pp >= 1), None).when(F.abs(q) <= 0.425, central)
             .otherwise(F.signum(q) * F.when(s <= 5.0, middle).otherwise(far)))
    return df.withColumn(name, value).drop("_pp", "_pq", "_ps", "_pr")


def norm_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
