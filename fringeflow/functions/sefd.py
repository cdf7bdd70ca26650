"""System equivalent flux density: models as columns of frequency, and the thermal noise they give."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class SefdModel(ABC):
    """Flux density (Jy) of one antenna at a frequency in Hz."""

    @abstractmethod
    def at(self, frequency: Column, effective: bool = False) -> Column: ...


@dataclass(frozen=True)
class PolynomialSefd(SefdModel):
    """A polynomial in MHz for each polarization, by rising power; NaN outside ``low`` to ``high`` MHz. ``efficiency`` is the correlator's."""

    low: float
    high: float
    coefficients: tuple[tuple[float, ...], ...]
    efficiency: float = 1.0

    def at(self, frequency: Column, effective: bool = False) -> Column:
        """The quadratic mean of the polarizations; with ``effective`` divided by the efficiency."""
        x = frequency / 1e6
        squares = F.lit(0.0)
        for powers in self.coefficients:
            value = F.lit(0.0)
            for c in reversed(powers):
                value = value * x + c
            squares = squares + value * value
        mean = F.sqrt(squares / len(self.coefficients)) / (self.efficiency if effective else 1.0)
        return F.when((x >= self.low) & (x <= self.high), mean).otherwise(float("nan"))


#: Coefficients of horizontal and vertical polarization by band.
BANDS = {
    "L": PolynomialSefd(900.0, 1670.0, ((2.08778760e02, 1.08462392e00, -1.24639611e-03, 4.00344294e-07), (7.57838984e02, -2.24205001e-01, -1.72161897e-04, 1.11118471e-07)), 0.96),
    "UHF": PolynomialSefd(580.0, 1015.0, ((1.20011355e03, -7.08771871e-01, -1.46789604e-03, 1.29596990e-06), (2.06467503e03, -4.16858417e00, 3.16131140e-03, -7.31852890e-07)), 0.96),
}


def model_of(band: str | None) -> SefdModel:
    if band not in BANDS:
        raise ValueError(f"no SEFD model of band {band}")
    return BANDS[band]


def thermal_noise(sefd: Column, antennas: int, seconds: Column, width: Column) -> Column:
    """Noise of a naturally weighted image: ``sefd`` has the efficiency in it, ``width`` is a channel's in Hz; null for fewer than two antennas and without time."""
    if antennas < 2:
        return F.lit(None).cast("double")
    return F.when(seconds > 0, sefd / F.sqrt(2.0 * antennas * (antennas - 1) * seconds * width))
