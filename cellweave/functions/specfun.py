"""Special functions as SQL text that Spark and other engines read alike."""

from __future__ import annotations

# Rational approximations of the error function (Abramowitz and Stegun 7.1.26) and of the normal
# quantile (Acklam).
_ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def lit(x: float) -> str:
    """A double literal in either engine."""
    return f"CAST({x!r} AS DOUBLE)"


def _horner(coefficients, x: str, last: float | None = None) -> str:
    out = lit(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {lit(c)})"
    return out if last is None else f"({out} * {x} + {lit(last)})"


def normal_cdf(x: str) -> str:
    u = f"(abs({x}) / {lit(2**0.5)})"
    t = f"(1 / (1 + {lit(_ERF[0])} * {u}))"
    tail = f"({_horner(_ERF[:0:-1], t)} * {t} * exp(-{u} * {u}))"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} / 2 ELSE {tail} / 2 END"


def normal_quantile(p: str) -> str:
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    q = f"(({p}) - {lit(0.5)})"
    tail = lambda s: f"{_horner(_C, s)} / {_horner(_D, s, 1.0)}"
    return f"CASE WHEN {p} < {lit(0.02425)} THEN {tail(low)} WHEN {p} <= {lit(0.97575)} THEN {_horner(_A, f'({q} * {q})')} * {q} / {_horner(_B, f'({q} * {q})', 1.0)} ELSE -({tail(high)}) END"


def return_level(rp: str, p: str, mu: str, sigma: str, xi: str, scale: str, u: str, f_u: str, cap: float = 0.9999, most: float = 300.0) -> str:
    """Lognormal body and generalized-Pareto tail of a zero-inflated annual maximum at return period ``rp``.

    ``f_u`` is the body's probability at the threshold ``u``; the tail's probability is capped at ``cap``.
    """
    q = f"(1 - 1 / ({rp} * {p}))"
    g = f"least(({q} - {f_u}) / (1 - {f_u}), {lit(cap)})"
    body = f"exp({mu} + {sigma} * ({normal_quantile(q)}))"
    light, heavy = f"{u} - {scale} * ln(1 - {g})", f"{u} + {scale} / {xi} * (pow(1 - {g}, -{xi}) - 1)"
    value = f"CASE WHEN {scale} IS NULL OR {q} <= {f_u} THEN {body} WHEN abs({xi}) < {lit(1e-6)} THEN {light} ELSE {heavy} END"
    return f"CASE WHEN {p} <= 0 OR 1 / ({rp} * {p}) >= 1 THEN {lit(0.0)} ELSE least(greatest({value}, {lit(0.0)}), {lit(most)}) END"
