"""The standard normal distribution as column arithmetic.

Spark has neither the distribution function nor its inverse, so both are
written as rational approximations that stay inside generated code. The
quantile is Wichura's AS 241 (1988), good to about 1e-15 relative; the tail is
Hart's (1968) approximation, good to about 1e-8 relative (its worst is at 7 to 9
deviations, where the tail itself is below 1e-11).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# AS 241 coefficients, lowest power first, centre / near tail / far tail.
_CENTRE_TOP = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
    3.3430575583588128105e4, 2.5090809287301226727e3,
)
_CENTRE_BOTTOM = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
    5.2264952788528545610e3,
)
_NEAR_TOP = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
    3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
    2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
_NEAR_BOTTOM = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
    1.05075007164441684324e-9,
)
_FAR_TOP = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
    2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
    2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
_FAR_BOTTOM = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
    2.04426310338993978564e-15,
)
# Hart's tail coefficients, lowest power first.
_TAIL_TOP = (
    220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383,
    6.37396220353165, 0.700383064443688, 3.52624965998911e-2,
)
_TAIL_BOTTOM = (
    440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674,
    86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-2,
)


def polynomial(coefficients: Sequence[float], x: Column) -> Column:
    """Value of a polynomial, coefficients lowest power first."""
    result = F.lit(float(coefficients[-1]))
    for coefficient in reversed(coefficients[:-1]):
        result = result * x + F.lit(float(coefficient))
    return result


def with_normal_quantile(table: DataFrame, p: Column, name: str) -> DataFrame:
    """Adds the z with probability ``p`` below it, for p strictly between 0 and 1.

    The intermediate values are columns of their own, so that the polynomials
    refer to them instead of repeating them.
    """
    steps = (
        table.withColumn("_p", p)
        .withColumn("_offset", F.col("_p") - 0.5)
        .withColumn("_square", F.lit(0.180625) - F.col("_offset") * F.col("_offset"))
        .withColumn("_depth", F.sqrt(-F.log(F.least(F.col("_p"), 1 - F.col("_p")))))
        .withColumns({"_near": F.col("_depth") - 1.6, "_far": F.col("_depth") - 5.0})
    )
    ratio = lambda top, bottom, x: polynomial(top, F.col(x)) / polynomial(bottom, F.col(x))
    tail = F.when(F.col("_depth") <= 5.0, ratio(_NEAR_TOP, _NEAR_BOTTOM, "_near")).otherwise(
        ratio(_FAR_TOP, _FAR_BOTTOM, "_far")
    )
    value = F.when(
        F.abs("_offset") <= 0.425, F.col("_offset") * ratio(_CENTRE_TOP, _CENTRE_BOTTOM, "_square")
    ).otherwise(F.signum("_offset") * tail)
    return steps.withColumn(name, value).drop(
        "_p", "_offset", "_square", "_depth", "_near", "_far"
    )


def with_normal_upper_tail(table: DataFrame, z: Column, name: str) -> DataFrame:
    """Adds the probability above ``z``; intermediate values are columns here too."""
    size = F.col("_size")
    fraction = size + 0.65
    for step in (4.0, 3.0, 2.0, 1.0):
        fraction = size + F.lit(step) / fraction
    body = polynomial(_TAIL_TOP, size) / polynomial(_TAIL_BOTTOM, size)
    far = F.lit(1.0) / fraction / F.lit(2.506628274631)
    tail = F.when(size > 37.0, F.lit(0.0)).otherwise(
        F.col("_density") * F.when(size < 7.07106781186547, body).otherwise(far)
    )
    return (
        table.withColumn("_z", z)
        .withColumn("_size", F.abs("_z"))
        .withColumn("_density", F.exp(-size * size / 2.0))
        .withColumn("_tail", tail)
        .withColumn(name, F.when(F.col("_z") >= 0, F.col("_tail")).otherwise(1.0 - F.col("_tail")))
        .drop("_z", "_size", "_density", "_tail")
    )
