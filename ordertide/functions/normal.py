"""Inverse standard-normal CDF as a Column expression.

Spark has no ``erf``/``ndtri``; this is Wichura's rational approximation
AS 241 (PPND16, about 16 digits over (0, 1)), evaluated JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published coefficients of AS 241, constant term first.
CENTRE_NUM = [3.3871328727963666080, 1.3314166789178437745e+2, 1.9715909503065514427e+3, 1.3731693765509461125e+4,
              4.5921953931549871457e+4, 6.7265770927008700853e+4, 3.3430575583588128105e+4, 2.5090809287301226727e+3]
CENTRE_DEN = [1.0, 4.2313330701600911252e+1, 6.8718700749205790830e+2, 5.3941960214247511077e+3,
              2.1213794301586595867e+4, 3.9307895800092710610e+4, 2.8729085735721942674e+4, 5.2264952788528545610e+3]
TAIL_NUM = [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
            1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
TAIL_DEN = [1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1,
            1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
FAR_NUM = [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1,
           2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
FAR_DEN = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
           7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]
CENTRE, CENTRE_SQUARE, TAIL_SHIFT, TAIL_END = 0.425, 0.180625, 1.6, 5.0


def _ratio(num: list[float], den: list[float], x: Column) -> Column:
    def poly(coefs):
        acc = F.lit(coefs[-1])
        for c in reversed(coefs[:-1]):
            acc = acc * x + F.lit(c)
        return acc
    return poly(num) / poly(den)


def probit(p: Column) -> Column:
    """Phi^{-1}(p) for p in (0, 1); NULL outside."""
    q = p - F.lit(0.5)
    centre = q * _ratio(CENTRE_NUM, CENTRE_DEN, F.lit(CENTRE_SQUARE) - q * q)
    r = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    tail = F.when(r <= TAIL_END, _ratio(TAIL_NUM, TAIL_DEN, r - F.lit(TAIL_SHIFT))).otherwise(
        _ratio(FAR_NUM, FAR_DEN, r - F.lit(TAIL_END)))
    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(F.abs(q) <= CENTRE, centre).otherwise(F.signum(q) * tail))
