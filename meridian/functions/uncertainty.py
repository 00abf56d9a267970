"""Values with variances: first-order propagation as pairs of native columns.

A Q holds two columns, so an expression over Qs stays two expressions that Catalyst can fold and generate code for.
Operands are taken as independent; `ref` names the covariance an operand belongs to, and two operands of one
covariance are refused when the plan is built, as their correlation would be lost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Q:
    value: Column
    variance: Column
    ref: str | None = None

    @classmethod
    def of(cls, value: str | float | Column, variance: str | float | Column = 0.0, ref: str | None = None) -> Q:
        as_column = lambda x: x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))
        return cls(as_column(value), as_column(variance), ref)

    def _with(self, other: Q | float) -> Q:
        other = other if isinstance(other, Q) else Q.of(float(other))
        if self.ref is not None and self.ref == other.ref:
            raise ValueError(f"both operands belong to covariance {self.ref!r}: propagate them together")
        return other

    def __add__(self, other: Q | float) -> Q:
        o = self._with(other)
        return Q(self.value + o.value, self.variance + o.variance)

    def __sub__(self, other: Q | float) -> Q:
        o = self._with(other)
        return Q(self.value - o.value, self.variance + o.variance)

    def __neg__(self) -> Q:
        return Q(-self.value, self.variance)

    def __mul__(self, other: Q | float) -> Q:
        o = self._with(other)
        return Q(self.value * o.value, o.value * o.value * self.variance + self.value * self.value * o.variance)

    def __truediv__(self, other: Q | float) -> Q:
        o = self._with(other)
        square = o.value * o.value
        return Q(self.value / o.value, self.variance / square + self.value * self.value * o.variance / (square * square))

    def __pow__(self, exponent: float) -> Q:
        slope = exponent * F.pow(self.value, F.lit(exponent - 1.0))
        return Q(F.pow(self.value, F.lit(float(exponent))), slope * slope * self.variance)

    def _map(self, value: Column, slope: Column) -> Q:
        return Q(value, slope * slope * self.variance)

    def alias(self, name: str) -> list[Column]:
        return [self.value.alias(name), self.variance.alias(f"{name}_variance")]

    def sigma(self) -> Column:
        return F.sqrt(self.variance)


def sin(q: Q) -> Q:
    return q._map(F.sin(q.value), F.cos(q.value))


def cos(q: Q) -> Q:
    return q._map(F.cos(q.value), F.sin(q.value))


def tan(q: Q) -> Q:
    t = F.tan(q.value)
    return q._map(t, 1.0 + t * t)


def _inverse_sine(q: Q, value: Column) -> Q:
    return Q(F.when(F.abs(q.value) < 1, value), F.when(F.abs(q.value) < 1, q.variance / (1.0 - q.value * q.value)))


def asin(q: Q) -> Q:
    """Null outside (-1, 1), where the variance has no bound."""
    return _inverse_sine(q, F.asin(q.value))


def acos(q: Q) -> Q:
    return _inverse_sine(q, F.acos(q.value))


def atan(q: Q) -> Q:
    return q._map(F.atan(q.value), 1.0 / (1.0 + q.value * q.value))


def exp(q: Q) -> Q:
    e = F.exp(q.value)
    return q._map(e, e)


def log(q: Q) -> Q:
    return q._map(F.ln(q.value), 1.0 / q.value)


def sqrt(q: Q) -> Q:
    return Q(F.sqrt(q.value), q.variance / (4.0 * q.value))


def atan2(y: Q, x: Q) -> Q:
    square = x.value * x.value + y.value * y.value
    return Q(F.atan2(y.value, x.value), (x.value * x.value * y.variance + y.value * y.value * x.variance) / (square * square))


def hypot(x: Q, y: Q) -> Q:
    square = x.value * x.value + y.value * y.value
    return Q(F.sqrt(square), (x.value * x.value * x.variance + y.value * y.value * y.variance) / square)


def transform(jacobian: list[list[Column | float]], covariance: list[list[Column]]) -> list[list[Column]]:
    """J S J' of small matrices of columns, as native expressions."""
    rows, n = len(jacobian), len(covariance)
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))

    def entry(i: int, j: int) -> Column:
        total = F.lit(0.0)
        for a in range(n):
            for b in range(n):
                if not (jacobian[i][a] == 0 if not isinstance(jacobian[i][a], Column) else False):
                    if not (jacobian[j][b] == 0 if not isinstance(jacobian[j][b], Column) else False):
                        total = total + lit(jacobian[i][a]) * covariance[a][b] * lit(jacobian[j][b])
        return total

    upper = {(i, j): entry(i, j) for i in range(rows) for j in range(i, rows)}
    return [[upper[min(i, j), max(i, j)] for j in range(rows)] for i in range(rows)]
