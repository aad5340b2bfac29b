"""Eigenvalues and eigenvectors of an integer covariance, by its exact polynomial.

The characteristic polynomial of a symmetric integer matrix without negative eigenvalues
is computed modulo primes, each by reduction to Hessenberg form, and put together by
Chinese remainders. How many primes it takes follows from a bound on the coefficients.

All roots of the polynomial are real, so the number of roots above a point is exactly the
number of sign changes in the coefficients shifted to that point (Descartes), multiple
roots counted as often. Bisection by that count, in integers, isolates the roots; the sign
of the polynomial alone then narrows an interval with a single one.

An eigenvector spans the null space of the matrix less its root. Inverse iteration in
long decimals finds it, for roots that coincide as a block of orthogonal vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np

# Products of two residues fit 64 bits.
_PRIMES_BELOW = 1 << 31
# Bits that the trace has on the grid on which roots are found, and a root at least;
# rounds of inverse iteration at most, and the change after which vectors are settled.
GRID_BITS, ROOT_BITS, MOST_ROUNDS = 128, 64, 60
SETTLED = Decimal("1e-24")

Matrix = list[list[int]]


def primes() -> Iterator[int]:
    """Primes below 2^31, the greatest first (Miller-Rabin, which 2, 3, 5 and 7 decide
    here)."""
    for n in range(_PRIMES_BELOW - 1, 3, -2):
        twos = ((n - 1) & (1 - n)).bit_length() - 1
        odd = (n - 1) >> twos
        for base in (2, 3, 5, 7):
            x = pow(base, odd, n)
            if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
                break
        else:
            yield n


def enough_primes(rows: Matrix) -> list[int]:
    """Primes whose product exceeds every coefficient of the polynomial of ``rows``.

    The coefficients are sums of products of eigenvalues, which are not negative; with a
    given sum (the trace) such a sum is greatest if all are equal (Maclaurin).
    """
    size, trace = len(rows), sum(rows[i][i] for i in range(len(rows)))
    bound = max(math.comb(size, k) * trace**k // size**k for k in range(size + 1)) + 1
    out, product = [], 1
    for p in primes():
        if product > bound:
            return out
        out.append(p)
        product *= p
    raise ValueError("a matrix beyond all primes")


def residues(rows: Matrix, p: int) -> list[int]:
    """Coefficients modulo ``p`` of the characteristic polynomial, the leading one last."""
    h = np.array([[x % p for x in r] for r in rows], np.int64)
    size = len(h)
    for k in range(size - 2):
        found = np.flatnonzero(h[k + 1 :, k])
        if not len(found):
            continue
        i = k + 1 + found[0]
        h[[k + 1, i]] = h[[i, k + 1]]
        h[:, [k + 1, i]] = h[:, [i, k + 1]]
        f = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - f[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * f % p).sum(1)) % p
    polynomials = np.zeros((size + 1, size + 1), np.int64)
    polynomials[0, 0] = 1
    for k in range(size):
        factors, below = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            factors[i] = int(h[i, k]) * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
        new = np.roll(polynomials[k], 1) - (factors[:, None] * polynomials[: k + 1] % p).sum(0)
        polynomials[k + 1] = new % p
    return polynomials[size].tolist()


def combined(found: dict[int, list[int]]) -> list[int]:
    """The sums of products of eigenvalues, of none to all of them, from the residues by
    prime."""
    product = math.prod(found)
    size = len(next(iter(found.values()))) - 1
    out = [0] * (size + 1)
    for p, coefficients in found.items():
        rest = product // p
        share = rest * pow(rest, -1, p)
        for k in range(size + 1):
            out[k] += share * coefficients[size - k]
    return [(x if k % 2 == 0 else -x) % product for k, x in enumerate(out)]


class Roots:
    """The roots of a polynomial given by its sums of products, times 2^``bits``."""

    def __init__(self, sums: list[int], bits: int):
        self.bits = bits
        self.c = [(s if k % 2 == 0 else -s) << bits * k for k, s in enumerate(sums)]
        while not self.c[-1]:  # a root at 0 each
            self.c.pop()
        self.positive = len(self.c) - 1
        self.top = (sums[1] << bits) if len(sums) > 1 else 0

    def above(self, t: int) -> int:
        """How many roots are greater than ``t``, not negative."""
        c = list(self.c)
        for end in range(len(c), 1, -1):
            for j in range(1, end):
                c[j] += t * c[j - 1]
        signs = [x > 0 for x in c if x]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def _value(self, t: int) -> int:
        out = 0
        for x in self.c:
            out = out * t + x
        return out

    def greatest(self, most: int) -> list[tuple[int, int]]:
        """(root, how often) in falling order, until ``most`` are found or no more are
        positive; a root lies less than 1 below the number given."""
        out: list[tuple[int, int]] = []
        open_ = [(0, self.top, self.positive, 0)]
        while open_ and sum(n for _, n in out) < most:
            low, high, at_low, at_high = open_.pop()
            n = at_low - at_high
            if not n:
                continue
            if high - low == 1:
                out.append((high, n))
                continue
            if n == 1:
                out.append((self._single(low, high, at_high), 1))
                continue
            middle = (low + high) // 2
            at_middle = self.above(middle)
            open_ += [(low, middle, at_low, at_middle), (middle, high, at_middle, at_high)]
        return out

    def _single(self, low: int, high: int, above: int) -> int:
        """The only root in (low, high], with so many above."""
        sign = -1 if above % 2 else 1
        while high - low > 1:
            middle = (low + high) // 2
            value = sign * self._value(middle)
            low, high = (low, middle) if value >= 0 else (middle, high)
        return high


def greatest_roots(sums: list[int], most: int) -> tuple[list[tuple[int, int]], int]:
    """The greatest positive eigenvalues times 2^bits, how often each, and the bits, which
    are as many as the smallest of them needs."""
    bits = max(0, GRID_BITS - sums[1].bit_length())
    while True:
        found = Roots(sums, bits).greatest(most)
        if all(root.bit_length() > ROOT_BITS for root, _ in found):
            return found, bits
        bits += ROOT_BITS


def null_vectors(rows: Matrix, root: int, bits: int, times: int) -> list[list[float]]:
    """Unit eigenvectors of ``rows`` for the eigenvalue ``root`` / 2^``bits``, as many as
    ``times``; the component greatest by amount is positive."""
    size = len(rows)
    with localcontext() as context:
        context.prec = 40 + int(0.61 * max(GRID_BITS, root.bit_length()))
        least = Decimal(10) ** (4 - context.prec)
        a = np.array([[Decimal((x << bits) - (root if i == j else 0)) for j, x in enumerate(r)] for i, r in enumerate(rows)])
        order, largest = list(range(size)), max(abs(x) for x in a.ravel()) or Decimal(1)
        for k in range(size):
            i = max(range(k, size), key=lambda r: abs(a[r, k]))
            a[[k, i]] = a[[i, k]]
            order[k], order[i] = order[i], order[k]
            if abs(a[k, k]) < largest * least:
                a[k, k] = largest * least
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])

        def solved(b: np.ndarray) -> np.ndarray:
            x = b[order]
            for k in range(1, size):
                x[k] -= a[k, :k] @ x[:k]
            for k in range(size - 1, -1, -1):
                x[k] = (x[k] - (a[k, k + 1 :] @ x[k + 1 :] if k + 1 < size else 0)) / a[k, k]
            return x

        start = np.random.default_rng(1).integers(-999, 1000, (times, size))
        found = [np.array([Decimal(int(x)) for x in s]) for s in start]
        for k in range(MOST_ROUNDS):
            new: list[np.ndarray] = []
            for v in map(solved, found):
                for _ in range(2):
                    for u in new:
                        v = v - (u @ v) * u
                    v = v / (v @ v).sqrt()
                new.append(v)
            # How far the new vectors lie outside the space of those before.
            rests = [v - sum((u @ v) * u for u in found) for v in new]
            found = new
            if k and max(abs(x) for rest in rests for x in rest) < SETTLED:
                break
        out = []
        for v in found:
            top = max(range(size), key=lambda i: (abs(v[i]), -i))
            out.append([float(x if v[top] > 0 else -x) for x in v])
        return out
