"""Number formats of the text reports and small numeric helpers."""

from __future__ import annotations

import math


def sig15(v: float | None) -> str:
    """Fifteen significant digits; scientific only where strictly shorter; NA, Inf and -Inf."""
    if v is None or math.isnan(v):
        return "NA"
    if math.isinf(v):
        return "Inf" if v > 0 else "-Inf"
    if v == 0:
        return "0"
    for digits in range(1, 16):
        s = f"{v:.{digits - 1}e}"
        if float(s) == float(f"{v:.14e}"):
            break
    mantissa, _, power = s.partition("e")
    exponent = int(power)
    fixed = f"{v:.{max(0, digits - 1 - exponent)}f}"
    scientific = f"{mantissa}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    return scientific if len(scientific) < len(fixed) else fixed


def one_place(v: float) -> str:
    return f"{v:.1f}"


def c_exponent(v: float) -> str:
    """Six places and a power of at least two digits."""
    return f"{v:e}"


def commas(n: int) -> str:
    return f"{n:,}"


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def depth_percentile(values: list[float], p: float) -> float:
    """position p(n+1)/100 in sorted values, cut to their ends, linear between neighbours."""
    if not values:
        return 0.0
    place = p * (len(values) + 1) / 100
    k = int(place)
    if k < 1:
        return values[0]
    if k >= len(values):
        return values[-1]
    return values[k - 1] + (place - k) * (values[k] - values[k - 1])


def pretty_breaks(low: float, high: float, n: int = 5) -> list[float]:
    """About n round steps from low to high."""
    if high <= low:
        return [low]
    raw = (high - low) / n
    unit = 10 ** math.floor(math.log10(raw))
    step = next(m * unit for m in (1, 2, 5, 10) if raw <= m * unit * (1 + 1e-9))
    first, last = math.floor(low / step + 1e-9), math.ceil(high / step - 1e-9)
    return [round(k * step, 12) for k in range(first, last + 1)]
