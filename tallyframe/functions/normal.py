"""The normal distribution as column expressions (Spark has no erf).

The cumulative distribution is the rational approximation of Hart (1968) in West's
(2005) form, its inverse is Wichura's AS241. Both come as SQL text as well, so
that another engine can compute the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Hart's polynomials
_HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)

# fixed values: AS241 (PPND16)
_CENTRE_TOP = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608)
_CENTRE_BOTTOM = (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)
_NEAR_TOP = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734)
_NEAR_BOTTOM = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0)
_FAR_TOP = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772)
_FAR_BOTTOM = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0)


def _number(x: float) -> str:
    return f"cast({x!r} as double)"


def _horner(x: str, terms: tuple[float, ...]) -> str:
    out = _number(terms[0])
    for t in terms[1:]:
        out = f"({out} * {x} + {_number(t)})"
    return out


def cdf_sql(x: str) -> str:
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2.0) * {_horner(a, _HART_TOP)} / {_horner(a, _HART_BOTTOM)}"
    tail = f"({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / ({a} + 4.0 / ({a} + cast(0.65 as double))))))"
    far = f"exp(-{a} * {a} / 2.0) / {tail} / {_number(2.506628274631)}"
    low = f"(case when {a} > 37 then cast(0 as double) when {a} < {_number(7.07106781186547)} then {near} else {far} end)"
    return f"(case when {x} > 0 then 1.0 - {low} else {low} end)"


def inverse_cdf_sql(p: str) -> str:
    q = f"({p} - cast(0.5 as double))"
    r0 = f"(cast(0.180625 as double) - {q} * {q})"
    centre = f"{q} * {_horner(r0, _CENTRE_TOP)} / {_horner(r0, _CENTRE_BOTTOM)}"
    r = f"sqrt(-ln(case when {q} < 0 then {p} else 1.0 - {p} end))"
    near, far = f"({r} - cast(1.6 as double))", f"({r} - cast(5 as double))"
    side = f"(case when {q} < 0 then cast(-1 as double) else cast(1 as double) end)"
    outer = f"(case when {r} <= 5 then {_horner(near, _NEAR_TOP)} / {_horner(near, _NEAR_BOTTOM)} else {_horner(far, _FAR_TOP)} / {_horner(far, _FAR_BOTTOM)} end)"
    return f"(case when abs{q} <= cast(0.425 as double) then {centre} else {side} * {outer} end)"


def cdf(x: str) -> Column:
    """x: an expression, evaluated several times; name a column."""
    return F.expr(cdf_sql(x))


def inverse_cdf(p: str) -> Column:
    return F.expr(inverse_cdf_sql(p))


def cdf_of(x: np.ndarray) -> np.ndarray:
    """The same function of numbers."""
    a = np.abs(x)
    near = np.polyval(_HART_TOP, a) / np.polyval(_HART_BOTTOM, a)
    far = 1 / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    low = np.where(a > 37, 0.0, np.exp(-a * a / 2) * np.where(a < 7.07106781186547, near, far))
    return np.where(x > 0, 1 - low, low)
