"""How weights combine across a join (add, multiply or a user's operation) and which results rank first (largest or smallest)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Operator:
    """An associative, commutative operation: its neutral value, its form on two columns and as an aggregate.

    ``monotone`` says that it keeps the order of its arguments, so that it can
    join weights in a ranking (MUL does for weights of at least 0); ``strict``
    that different arguments also give different results, unless the other one
    is ``absorbing``. Where it isn't strict, equal scores are kept with a cut.
    """

    name: str
    zero: int | float
    merge: Callable[[Column, Column], Column]
    fold: Callable[[Column], Column]
    monotone: bool = True
    strict: bool = False
    absorbing: int | float | None = None

    def combine(self, a: Column, b: Column) -> Column:
        return self.merge(a, b)

    def all(self, columns: list[Column]) -> Column:
        return reduce(self.merge, columns) if columns else F.lit(self.zero)

    def aggregate(self, column: Column) -> Column:
        return self.fold(column)

    @classmethod
    def of(cls, name: str, zero: int | float, merge: Callable[[Column, Column], Column], monotone: bool = True) -> Operator:
        """A user's operation; its aggregate folds the group's values, which one task holds (give ``fold`` where Spark has an aggregate)."""
        return cls(name, zero, merge, lambda c: F.reduce(F.collect_list(c), F.lit(zero), merge), monotone)


ADD = Operator("ADD", 0, lambda a, b: a + b, F.sum, strict=True)
MUL = Operator("MUL", 1, lambda a, b: a * b, F.product, strict=True, absorbing=0)
MAX = Operator("MAX", -(2**63), F.greatest, F.max)
MIN = Operator("MIN", 2**63 - 1, F.least, F.min)


@dataclass(frozen=True)
class Ranking:
    """``times`` joins weights, ``best`` (MAX or MIN) ranks. MUL needs weights of at least 0: bounds rely on monotonicity."""

    times: Operator = ADD
    best: Operator = MAX

    def __post_init__(self):
        if self.best not in (MAX, MIN) or not self.times.monotone:
            raise ValueError("weights are joined by a monotone operation and ranked by MAX or MIN")

    @property
    def largest(self) -> bool:
        return self.best is MAX

    def order(self, column: str) -> Column:
        return F.desc(column) if self.largest else F.asc(column)

    def reaches(self, score: Column, bar: Column) -> Column:
        return score >= bar if self.largest else score <= bar
