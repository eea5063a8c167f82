"""Linear prediction of one block: windows, all-orders recursion, analytic choice of orders, quantisation."""

from __future__ import annotations

import numpy as np

# Orders that are tried, how many of them exactly, and the coefficient widths.
ORDERS, SHORTLIST, WIDTH, WIDTHS, MOST_SHIFT = (1, 2, 4, 6, 8, 12, 16, 24, 32), 3, 14, (10, 12, 14), 31


def window(kind: str, n: int) -> np.ndarray:
    """Welch, Tukey with half its length tapered, Hann, or none."""
    x = (np.arange(n) + 0.5) / n
    if kind == "welch":
        return 1 - (2 * x - 1) ** 2
    if kind == "hann":
        return 0.5 - 0.5 * np.cos(2 * np.pi * x)
    if kind == "tukey":
        edge = np.minimum(x, 1 - x)
        return np.where(edge < 0.25, 0.5 - 0.5 * np.cos(4 * np.pi * edge), 1.0)
    return np.ones(n)


def levinson(r: np.ndarray, most: int) -> list[tuple[np.ndarray, float]]:
    """Coefficients and expected error energy of every order from 1 on, as far as the error stays positive."""
    a, error, out = np.zeros(0), float(r[0]), []
    for m in range(1, most + 1):
        if error <= 0:
            break
        k = (r[m] - a @ r[m - 1 : 0 : -1][: m - 1]) / error if m > 1 else r[1] / error
        a = np.append(a - k * a[::-1], k)
        error *= 1 - k * k
        if not np.isfinite(error):
            break
        out.append((a, error))
    return out


def bits_of(error: float, n: int) -> float:
    """Expected bits of n residuals of an error energy: those of a Laplace distribution."""
    spread = np.sqrt(max(error, 1e-9) / n / 2)
    return n * max(0.5, np.log2(2 * np.e * max(spread, 0.2)))


def shortlist(x: np.ndarray, kinds: tuple[str, ...] = ("tukey", "welch"), orders: tuple[int, ...] = ORDERS, most: int = SHORTLIST) -> list[tuple[float, int, np.ndarray]]:
    """The `most` candidates (expected bits, order, coefficients) of a block over windows and orders, best first."""
    top = min(max(orders), len(x) // 2 - 1)
    if top < 1 or x.min() == x.max():
        return []
    found = []
    for kind in kinds:
        w = x * window(kind, len(x))
        energy = float((window(kind, len(x)) ** 2).mean())
        r = np.array([w[: len(w) - j] @ w[j:] for j in range(top + 1)])
        r[0] *= 1 + 1e-9
        steps = levinson(r, top)
        found += [(bits_of(steps[m - 1][1] / energy, len(x)) + m * 9.0, m, steps[m - 1][0]) for m in orders if m <= len(steps)]
    best: dict[int, tuple] = {}
    for c in sorted(found, key=lambda c: (c[0], c[1])):
        best.setdefault(c[1], c)
    return list(best.values())[:most]


def quantise(a: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, int] | None:
    """Integer coefficients and their shift; each one's rounding error is carried into the next."""
    peak = float(np.abs(a).max(initial=0))
    if not np.isfinite(peak) or peak == 0:
        return None
    shift = min(MOST_SHIFT, width - 2 - int(np.floor(np.log2(peak))))
    if shift < 0:
        return None
    limit, left, out = (1 << width - 1) - 1, 0.0, []
    for v in a * 2.0**shift:
        q = max(-limit, min(limit, int(np.rint(v + left))))
        left += v - q
        out.append(q)
    return np.array(out, np.int64), shift


def residual(x: np.ndarray, q: np.ndarray, shift: int) -> np.ndarray:
    """Residual of x after its first len(q) values."""
    n = len(q)
    total = np.zeros(len(x) - n, np.int64)
    for j, c in enumerate(q.tolist()):
        if c:
            total += c * x[n - 1 - j : len(x) - 1 - j]
    return x[n:] - (total >> shift)
