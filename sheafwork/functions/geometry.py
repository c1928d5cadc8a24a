"""Matrices of six numbers, for row vectors: the product m * n applies m first."""

from __future__ import annotations

import math
from typing import NamedTuple


class Matrix(NamedTuple):
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 1.0
    e: float = 0.0
    f: float = 0.0

    def __mul__(self, n: Matrix) -> Matrix:
        a, b, c, d, e, f = self
        return Matrix(a * n.a + b * n.c, a * n.b + b * n.d, c * n.a + d * n.c, c * n.b + d * n.d, e * n.a + f * n.c + n.e, e * n.b + f * n.d + n.f)

    def point(self, x: float, y: float) -> tuple[float, float]:
        return self.a * x + self.c * y + self.e, self.b * x + self.d * y + self.f

    def vector(self, x: float, y: float) -> tuple[float, float]:
        return self.a * x + self.c * y, self.b * x + self.d * y

    def moved(self, x: float, y: float) -> Matrix:
        """The same, with (x, y) added to its translation."""
        return self._replace(e=self.e + x, f=self.f + y)

    @classmethod
    def translation(cls, x: float, y: float) -> Matrix:
        return cls(e=x, f=y)

    @classmethod
    def scaling(cls, x: float, y: float) -> Matrix:
        return cls(a=x, d=y)

    @classmethod
    def rotation(cls, angle: float) -> Matrix:
        return cls(math.cos(angle), math.sin(angle), -math.sin(angle), math.cos(angle))

    @classmethod
    def of(cls, values) -> Matrix:
        values = [float(v) for v in values]
        if len(values) != 6:
            raise ValueError(f"a matrix has six numbers, not {len(values)}")
        return cls(*values)


IDENTITY = Matrix()
