"""The normal distribution, as Spark columns and as small numpy helpers."""

from __future__ import annotations

import math
import sys
from functools import reduce
from statistics import NormalDist

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])    # workers need no copy of the package

# Coefficients of Wichura's algorithm AS 241 (1988), lowest power first.
CENTRE_NUM = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
              4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3]
CENTRE_DEN = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
              2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]
MIDDLE_NUM = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
              1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
MIDDLE_DEN = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
              1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
TAIL_NUM = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
            2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
TAIL_DEN = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
            7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]

# Coefficients of Hart's rational approximation of the normal tail (1968), highest power first.
HART_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376]
HART_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def _horner(x: Column, highest_first: list[float]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), highest_first[1:], F.lit(highest_first[0]))


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile of a probability strictly between 0 and 1, JVM side."""
    def ratio(x: Column, num: list[float], den: list[float]) -> Column:
        return _horner(x, num[::-1]) / _horner(x, den[::-1])

    q = p - F.lit(0.5)
    near = F.lit(0.180625) - q * q
    r = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))
    far = F.when(r <= 5, ratio(r - F.lit(1.6), MIDDLE_NUM, MIDDLE_DEN)).otherwise(
        ratio(r - F.lit(5.0), TAIL_NUM, TAIL_DEN))
    return F.when(F.abs(q) <= 0.425, q * ratio(near, CENTRE_NUM, CENTRE_DEN)).otherwise(F.signum(q) * far)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, JVM side, to about 14 digits within 7 deviations."""
    a = F.abs(z)
    tail = F.exp(-a * a / 2) * _horner(a, HART_NUM) / _horner(a, HART_DEN)
    tail = F.when(a > 7, F.exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + F.lit(0.65))))) / math.sqrt(2 * math.pi)
                  ).otherwise(tail)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def _poly(highest_first: list[float], x: float) -> float:
    return float(np.polyval(highest_first, x))


# Royston's AS R94 (1995) corrections of the two outer weights and of the null distribution of W.
OUTER_WEIGHT = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0]
NEXT_WEIGHT = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
SMALL_SHIFT = [0.459, -2.273]
SMALL_MEAN = [-0.0006714, 0.025054, -0.39978, 0.5440]
SMALL_LOG_SD = [-0.0020322, 0.062767, -0.77857, 1.3822]
LARGE_MEAN = [0.0038915, -0.083751, -0.31082, -1.5861]
LARGE_LOG_SD = [0.0030302, -0.082676, -0.4803]


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p of one bounded sample (8 to 5000 values); NaN for a constant one."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 8 or x[0] == x[-1]:
        return math.nan, math.nan
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    norm2, u = float(m @ m), 1.0 / math.sqrt(n)
    last = _poly(OUTER_WEIGHT, u) + m[-1] / math.sqrt(norm2)
    prev = _poly(NEXT_WEIGHT, u) + m[-2] / math.sqrt(norm2)
    left = (norm2 - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last ** 2 - 2 * prev ** 2)
    weights = m / math.sqrt(left)
    weights[[0, 1, -2, -1]] = [-last, -prev, prev, last]
    centred = x - x.mean()
    w = min(1.0, float(weights @ centred) ** 2 / float(centred @ centred))
    if w >= 1.0:
        return w, 1.0
    if n <= 11:
        y = -math.log(_poly(SMALL_SHIFT, n) - math.log(1 - w))
        mean, sd = _poly(SMALL_MEAN, n), math.exp(_poly(SMALL_LOG_SD, n))
    else:
        y, ln = math.log(1 - w), math.log(n)
        mean, sd = _poly(LARGE_MEAN, ln), math.exp(_poly(LARGE_LOG_SD, ln))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))


# The tail of the Kolmogorov-Smirnov distance to a normal with estimated mean and deviation, by Dallal and Wilkinson
# (1986) up to a probability of 0.1 and by polynomials in Stephens' (1974) modified distance above it.
LILLIEFORS_TAIL = (-7.01256, 2.78019, 2.99587, -0.122119, 0.974598, 1.67997)
LILLIEFORS_LOW = (2.76773, -19.828315, 80.709644, -138.55152, 81.218052)
LILLIEFORS_HIGH = (-4.901232, 40.662806, -97.490286, 94.029866, -32.355711)
STEPHENS = (0.01, 0.85)


def lilliefors_p(d: Column, n: Column) -> Column:
    """Probability of a distance of at least ``d`` of ``n`` values to the normal fitted to them, as a column; NULL below 5 values.

    Beyond 100 values the distance is taken to that of 100 values with the same modified distance, on which the tail depends.
    """
    n = n.cast("double")
    scale = lambda m: F.sqrt(m) - STEPHENS[0] + STEPHENS[1] / F.sqrt(m)
    modified, most = scale(n) * d, F.least(n, F.lit(100.0))
    at = modified / scale(most)
    a, b, c, e, f, g = LILLIEFORS_TAIL
    tail = F.exp(a * at * at * (most + b) + c * at * F.sqrt(most + b) + e + f / F.sqrt(most) + g / most)
    power = lambda k: reduce(lambda x, c: x * modified + c, map(F.lit, k[::-1]))
    near = F.when(modified <= 0.302, 1.0).when(modified <= 0.5, power(LILLIEFORS_LOW)).when(modified <= 0.9, power(LILLIEFORS_HIGH)).otherwise(tail)
    return F.when(n >= 5, F.least(F.lit(1.0), F.when(tail > 0.1, near).otherwise(tail)))
