"""Polarizations of a sample, kept as arrays: Mueller matrices, weights and flags without unrolling them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.polarization import mueller

CIRCULAR = ["RR", "RL", "LR", "LL"]


def circular_pair(outputs: list[str], inputs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Matrices from the circular frame to ``outputs`` and from ``inputs`` to it; ValueError unless ``inputs`` make a full basis."""
    return mueller(outputs, CIRCULAR), mueller(CIRCULAR, inputs)


@dataclass(frozen=True)
class Complex:
    """A complex value of two columns; a plain Python number stands for a constant, so that zeros and ones cost nothing."""

    re: Column | float
    im: Column | float

    def __mul__(self, other: Complex) -> Complex:
        return Complex(_less(_times(self.re, other.re), _times(self.im, other.im)), _plus(_times(self.re, other.im), _times(self.im, other.re)))

    def __add__(self, other: Complex) -> Complex:
        return Complex(_plus(self.re, other.re), _plus(self.im, other.im))

    def is_zero(self) -> bool:
        return not isinstance(self.re, Column) and not isinstance(self.im, Column) and self.re == 0 and self.im == 0


def _is(x: Column | float, value: float) -> bool:
    return not isinstance(x, Column) and x == value


def _times(a: Column | float, b: Column | float) -> Column | float:
    if _is(a, 0) or _is(b, 0):
        return 0.0
    return b if _is(a, 1) else a if _is(b, 1) else a * b


def _plus(a: Column | float, b: Column | float) -> Column | float:
    return b if _is(a, 0) else a if _is(b, 0) else a + b


def _less(a: Column | float, b: Column | float) -> Column | float:
    return a if _is(b, 0) else -b if _is(a, 0) else a - b


Matrix = list[list[Complex]]


def matrix(m: np.ndarray) -> Matrix:
    return [[Complex(float(x.real), float(x.imag)) for x in row] for row in np.asarray(m, complex)]


def _product(a: Matrix, b: Matrix) -> Matrix:
    zero = Complex(0.0, 0.0)
    return [[sum((x * y for x, y in zip(row, column) if not (x.is_zero() or y.is_zero())), zero) for column in zip(*b)] for row in a]


def with_phases(samples: DataFrame, angle1: Column, angle2: Column) -> DataFrame:
    """``samples`` with what ``parallactic`` needs of the angles at which their two feeds stand."""
    return samples.withColumns({f"_{f.__name__}_{n}": F.coalesce(f(a), F.lit(math.nan)) for n, a in (("difference", angle1 - angle2), ("sum", angle1 + angle2)) for f in (F.cos, F.sin)})


def parallactic(outputs: list[str], inputs: list[str]) -> Matrix:
    """The matrix of samples ``with_phases``: rows of the circular frame are turned by sum and difference of the angles."""
    out, into = circular_pair(outputs, inputs)
    cos, sin = ({n: F.col(f"_{f}_{n}") for n in ("difference", "sum")} for f in ("cos", "sin"))
    turns = {"RR": ("difference", False), "RL": ("sum", False), "LR": ("sum", True), "LL": ("difference", True)}
    phase = {c: Complex(cos[n], -sin[n] if back else sin[n]) for c, (n, back) in turns.items()}
    return _product(matrix(out), [[phase[c] * x for x in row] for c, row in zip(CIRCULAR, matrix(into))])


def _column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def apply(samples: DataFrame, m: Matrix) -> DataFrame:
    """``samples`` with arrays re, im and weight (an entry a polarization) turned by the matrix ``m``, all in plain expressions of the entries: nothing is unrolled.

    * A sample with a zero weight in any input goes: one contaminated input spoils all outputs.
    * A coefficient of 0 takes nothing, even of a value that is not finite.
    * Output weights are 1 / sum(abs(M)^2 / abs(weight)): variances are added, covariances left out.
    * An output that is not finite loses value and weight; a sample whose first output then has no weight goes.

    A polarization that no coefficient reaches has infinite weight, and so loses value and weight too. Missing (null) arrays and entries count as weight 0.
    Columns whose names begin with an underscore are dropped.
    """
    count = len(m[0])
    # no entry is null from here on, which keeps the generated code small
    entry = {f"_{c}{q}": F.coalesce(F.get(c, F.lit(q)).cast("double"), F.lit(missing)) for q in range(count) for c, missing in (("re", math.nan), ("im", math.nan), ("weight", 0.0))}
    weight = [F.abs(F.col(f"_weight{q}")) for q in range(count)]
    there = F.lit(True)
    for w in weight:
        there = there & (w != 0)
    # coefficients that differ by sample are computed once, before they are used
    named = {f"_{part}_{p}_{q}": getattr(c, part) for p, row in enumerate(m) for q, c in enumerate(row) for part in ("re", "im") if isinstance(getattr(c, part), Column)}
    of = lambda p, q, part: F.col(f"_{part}_{p}_{q}") if f"_{part}_{p}_{q}" in named else getattr(m[p][q], part)
    m = [[Complex(of(p, q, "re"), of(p, q, "im")) for q in range(count)] for p in range(len(m))]
    d = samples.withColumns(entry | named).where(there)
    given = [Complex(F.col(f"_re{q}"), F.col(f"_im{q}")) for q in range(count)]
    made = {}
    for p, row in enumerate(m):
        value, variance = Complex(0.0, 0.0), 0.0
        for c, x, w in zip(row, given, weight):
            if c.is_zero():
                continue
            term, share = c * x, (_plus(_times(c.re, c.re), _times(c.im, c.im)) if isinstance(c.re, Column) or isinstance(c.im, Column) else c.re**2 + c.im**2) / w
            if isinstance(c.re, Column) or isinstance(c.im, Column):
                nothing = (_column(c.re) == 0) & (_column(c.im) == 0)
                term, share = Complex(F.when(nothing, 0.0).otherwise(_column(term.re)), F.when(nothing, 0.0).otherwise(_column(term.im))), F.when(nothing, 0.0).otherwise(share)
            value, variance = value + term, _plus(variance, share)
        made |= {f"_r{p}": _column(value.re), f"_i{p}": _column(value.im), f"_s{p}": _column(variance)}
    columns = [c for c in samples.columns if not c.startswith("_")]
    d = d.select(*columns, *[c.alias(n) for n, c in made.items()])
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = [finite(F.col(f"_r{p}")) & finite(F.col(f"_i{p}")) & (F.col(f"_s{p}") > 0) for p in range(len(m))]
    kept = lambda name: [F.when(u, F.col(f"_{name}{p}")).otherwise(0.0) for p, u in enumerate(usable)]
    inverse = [F.when(u, 1 / F.col(f"_s{p}")).otherwise(0.0) for p, u in enumerate(usable)]
    out = {"re": F.array(*kept("r")), "im": F.array(*kept("i")), "weight": F.array(*inverse)}
    return d.where(usable[0]).select(*[out[c].alias(c) if c in out else F.col(c) for c in columns])


def unrolled(samples: DataFrame) -> DataFrame:
    """A row a polarization: (row, channel, pol, u, v, w, weight, re, im) of samples with arrays."""
    each = samples.select(F.col("row_id").alias("row"), F.col("channel").cast("long").alias("channel"), *"uvw", F.posexplode(F.arrays_zip("weight", "re", "im")).alias("pol", "x"))
    return each.select("row", "channel", F.col("pol").cast("long").alias("pol"), *"uvw", "x.weight", "x.re", "x.im")
