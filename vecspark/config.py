"""The codec's configuration and its hash."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecspark.errors import InvalidDimension, InvalidSeed, UnsupportedBitWidth

#: Fixed values of the formats.
BIT_WIDTHS = (2, 4, 8)
MAX_DIMENSION = 16384
MAX_SEED = 2**64 - 1


@dataclass(frozen=True)
class CodecConfig:
    """Bits per coordinate, seed of the rotation, dimension, and whether residuals are kept."""

    bit_width: int
    seed: int
    dimension: int
    residual_enabled: bool = True
    config_hash: str = field(init=False, compare=False)

    def __post_init__(self) -> None:
        if self.bit_width not in BIT_WIDTHS:
            raise UnsupportedBitWidth(f"bit width {self.bit_width} is none of {BIT_WIDTHS}")
        if not 0 <= self.seed <= MAX_SEED:
            raise InvalidSeed(f"seed {self.seed} is not an unsigned 64-bit integer")
        if not 1 <= self.dimension <= MAX_DIMENSION:
            raise InvalidDimension(f"dimension {self.dimension} is outside 1..{MAX_DIMENSION}")
        object.__setattr__(self, "config_hash", hashlib.sha256(self.canonical.encode()).hexdigest())

    @property
    def canonical(self) -> str:
        parts = (f"{name}={getattr(self, name)}" for name in ("bit_width", "seed", "dimension", "residual_enabled"))
        return f"CodecConfig({','.join(parts)})"

    @property
    def entries(self) -> int:
        return 1 << self.bit_width


def config_hash(bit_width: Column, seed: Column, dimension: Column, residual_enabled: Column) -> Column:
    """The hash of configurations in columns."""
    names = {"bit_width": bit_width, "seed": seed, "dimension": dimension}
    parts = [F.concat(F.lit(f"{name}="), column.cast("string")) for name, column in names.items()]
    parts.append(F.concat(F.lit("residual_enabled="), F.when(residual_enabled, "True").otherwise("False")))
    return F.sha2(F.concat(F.lit("CodecConfig("), F.concat_ws(",", *parts), F.lit(")")).cast("binary"), 256)
