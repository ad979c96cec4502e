"""The normal quantile as plain arithmetic, so that it stays inside generated code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The coefficients of algorithm AS 241 (Wichura 1988), routine PPND16, lowest power first.
CENTRE_A = ("3.3871328727963666080e0", "1.3314166789178437745e2", "1.9715909503065514427e3", "1.3731693765509461125e4", "4.5921953931549871457e4", "6.7265770927008700853e4", "3.3430575583588128105e4", "2.5090809287301226727e3")
CENTRE_B = ("1.0e0", "4.2313330701600911252e1", "6.8718700749205790830e2", "5.3941960214247511077e3", "2.1213794301586595867e4", "3.9307895800092710610e4", "2.8729085735721942674e4", "5.2264952788528545610e3")
MIDDLE_C = ("1.42343711074968357734e0", "4.63033784615654529590e0", "5.76949722146069140550e0", "3.64784832476320460504e0", "1.27045825245236838258e0", "2.41780725177450611770e-1", "2.27238449892691845833e-2", "7.74545014278341407640e-4")
MIDDLE_D = ("1.0e0", "2.05319162663775882187e0", "1.67638483018380384940e0", "6.89767334985100004550e-1", "1.48103976427480074590e-1", "1.51986665636164571966e-2", "5.47593808499534494600e-4", "1.05075007164441684324e-9")
TAIL_E = ("6.65790464350110377720e0", "5.46378491116411436990e0", "1.78482653991729133580e0", "2.96560571828504891230e-1", "2.65321895265761230930e-2", "1.24266094738807843860e-3", "2.71155556874348757815e-5", "2.01033439929228813265e-7")
TAIL_F = ("1.0e0", "5.99832206555887937690e-1", "1.36929880922735805310e-1", "1.48753612908506148525e-2", "7.86869131145613259100e-4", "1.84631831751005468180e-5", "1.42151175831644588870e-7", "2.04426310338993978564e-15")


def _polynomial(coefficients: tuple[str, ...], x: str) -> str:
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = f"({c} + {x} * {out})"
    return out


def normal_quantile_sql(u: str) -> str:
    """SQL, in any common dialect, of the normal quantile of u (a column or expression in (0, 1))."""
    q = f"({u} - 0.5e0)"
    r = f"(0.180625e0 - {q} * {q})"
    far = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {u} ELSE 1e0 - {u} END))"
    middle = f"{_polynomial(MIDDLE_C, f'({far} - 1.6e0)')} / {_polynomial(MIDDLE_D, f'({far} - 1.6e0)')}"
    tail = f"{_polynomial(TAIL_E, f'({far} - 5e0)')} / {_polynomial(TAIL_F, f'({far} - 5e0)')}"
    outer = f"(CASE WHEN {q} < 0 THEN -1e0 ELSE 1e0 END) * (CASE WHEN {far} <= 5e0 THEN {middle} ELSE {tail} END)"
    return f"(CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {_polynomial(CENTRE_A, r)} / {_polynomial(CENTRE_B, r)} ELSE {outer} END)"


def normal_quantile(column: str) -> Column:
    """Normal quantile of a column of values in (0, 1)."""
    return F.expr(normal_quantile_sql(f"`{column}`"))


def normal_quantile_of(u: np.ndarray) -> np.ndarray:
    """Normal quantiles of an array of values in (0, 1), by the same polynomials."""
    value = lambda coefficients, x: np.polynomial.polynomial.polyval(x, [float(c) for c in coefficients])
    q = np.asarray(u, float) - 0.5
    r = 0.180625 - q * q
    far = np.sqrt(-np.log(np.where(q < 0, u, 1 - u)))
    middle = value(MIDDLE_C, far - 1.6) / value(MIDDLE_D, far - 1.6)
    tail = value(TAIL_E, far - 5) / value(TAIL_F, far - 5)
    outer = np.where(q < 0, -1.0, 1.0) * np.where(far <= 5, middle, tail)
    return np.where(np.abs(q) <= 0.425, q * value(CENTRE_A, r) / value(CENTRE_B, r), outer)
