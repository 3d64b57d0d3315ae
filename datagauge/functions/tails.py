"""Tail probabilities for statistics that are already aggregated to one row."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = value
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(value - before) <= 1e-15 * abs(value):
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, degrees: float) -> float:
    """Two-sided tail probability of Student's t."""
    if math.isinf(t):
        return 0.0
    return incomplete_beta(degrees / 2.0, 0.5, degrees / (degrees + t * t))


def kolmogorov_two_sided(distance: float, n: int) -> float:
    """Tail probability of the two-sided Kolmogorov statistic for n values.

    Up to 400 values: the exact matrix form of Durbin (Marsaglia, Tsang and Wang 2003). Beyond: the limit
    series at Vrbik's corrected argument, whose error falls as n to the power -3/2.
    """
    if distance <= 0.0:
        return 1.0
    if distance >= 1.0:
        return 0.0
    if n * distance * distance > 18.0:
        return min(1.0, 2.0 * math.exp(-2.0 * n * distance * distance))
    if n <= 400:
        return min(1.0, max(0.0, 1.0 - _kolmogorov_matrix(distance, n)))
    root = math.sqrt(n) * distance
    x = root + 1.0 / (6.0 * math.sqrt(n)) + (root - 1.0) / (4.0 * n)
    if x < 0.3:
        return 1.0
    tail = 2.0 * sum((-1.0) ** (k - 1) * math.exp(-2.0 * k * k * x * x) for k in range(1, 101))
    return min(1.0, max(0.0, tail))


def _kolmogorov_matrix(distance: float, n: int) -> float:
    k = int(n * distance) + 1
    size = 2 * k - 1
    h = k - n * distance
    matrix = np.tri(size, size, 1)
    powers = h ** np.arange(1, size + 1)
    matrix[:, 0] -= powers
    matrix[-1, :] -= powers[::-1]
    if 2 * h - 1 > 0:
        matrix[-1, 0] += (2 * h - 1) ** size
    for i in range(size):
        for j in range(min(i + 2, size)):
            matrix[i, j] /= math.factorial(i - j + 1) if i - j + 1 > 0 else 1.0
    result, exponent = np.eye(size), 0
    base, base_exponent, power = matrix, 0, n
    while power:
        if power & 1:
            result, exponent = result @ base, exponent + base_exponent
        base, base_exponent = base @ base, 2 * base_exponent
        for_scale = base[k - 1, k - 1]
        if for_scale > 1e140:
            base, base_exponent = base * 1e-140, base_exponent + 140
        if result[k - 1, k - 1] > 1e140:
            result, exponent = result * 1e-140, exponent + 140
        power >>= 1
    value = result[k - 1, k - 1]
    log_value = math.log(value) + exponent * math.log(10.0) + math.lgamma(n + 1) - n * math.log(n)
    return math.exp(log_value)


# The coefficients of Wichura's rational approximations (AS 241), highest power first, for the centre, the
# tail and the far tail: numerator and denominator of each.
_CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def normal_quantile_sql(p: str) -> str:
    """SQL of the value below which a standard normal one lies with probability ``p``, an expression between 0 and 1.

    The text is plain enough for other engines too; ``p`` is repeated, so it should be a column.
    """

    def ratio(parts: tuple, x: str) -> str:
        sides = []
        for coefficients in parts:
            text = f"CAST({coefficients[0]!r} AS DOUBLE)"
            for c in coefficients[1:]:
                text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
            sides.append(text)
        return f"{sides[0]} / {sides[1]}"

    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    tail = f"CASE WHEN {r} <= 5 THEN {ratio(_TAIL, f'({r} - 1.6)')} ELSE {ratio(_FAR, f'({r} - 5)')} END"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(_CENTRE, f'(0.180625 - {q} * {q})')} ELSE sign({q}) * ({tail}) END"


def shapiro_weights(n: int, norm2: float) -> tuple[float, float | None, float]:
    """(last weight, last but one or null for under 6 values, divisor of the other scores), by Royston 1995.

    ``norm2`` is the sum of squares of the normal scores of the ranks.
    """
    normal, u = NormalDist(), 1.0 / math.sqrt(n)
    top, next_ = (normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in (n, n - 1))
    # Royston's polynomial coefficients.
    last = float(np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, top / math.sqrt(norm2)], u))
    if n <= 5:
        return last, None, math.sqrt((norm2 - 2 * top**2) / (1 - 2 * last**2))
    second = float(np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, next_ / math.sqrt(norm2)], u))
    return last, second, math.sqrt((norm2 - 2 * top**2 - 2 * next_**2) / (1 - 2 * last**2 - 2 * second**2))


def shapiro_tail(w: float, n: int) -> float:
    """p-value of the Shapiro-Wilk statistic of n values, by Royston 1995."""
    if w >= 1.0:
        return 1.0
    # Royston's polynomial coefficients.
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        mean = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        deviation = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        if gamma - math.log1p(-w) <= 0:
            return 0.0
        z = (-math.log(gamma - math.log1p(-w)) - mean) / deviation
    else:
        log_n = math.log(n)
        mean = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n)
        deviation = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
        z = (math.log1p(-w) - mean) / deviation
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def shapiro_of_sums(n: int, norm2: float, scored: float, spread: float, ends: tuple[float, float, float, float]) -> tuple[float, float]:
    """W statistic and p-value of n values, 4 at least, from sums over their global ranks.

    ``scored`` is the sum of normal score times value and ``spread`` the sum of squares, both of the values less their
    mean; ``ends`` are the two smallest and the two largest of these, in ascending order.
    """
    if not spread or ends[0] == ends[-1]:
        return 1.0, 1.0
    last, second, divisor = shapiro_weights(n, norm2)
    normal = NormalDist()
    scores = [normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in (1, 2, n - 1, n)]
    special = [(0, -last), (3, last)] + ([] if second is None else [(1, -second), (2, second)])
    # Scores of the ends are taken off the sum and their own weights put in place.
    total = scored - sum(scores[i] * ends[i] for i, _ in special)
    weighted = total / divisor + sum(weight * ends[i] for i, weight in special)
    w = min(1.0, weighted**2 / spread)
    return w, shapiro_tail(w, n)


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W statistic and p-value of a few values at hand, 4 at least."""
    x = np.sort(np.asarray(values, dtype=float))
    n, d = len(x), x - x.mean()
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    return shapiro_of_sums(n, float(m @ m), float(m @ d), float(d @ d), (d[0], d[1], d[-2], d[-1]))
