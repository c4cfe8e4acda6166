"""Column functions: grids, geodesy and flow-direction encodings."""

from thalweg.functions import encodings, grid
from thalweg.functions.grid import GridSpec

__all__ = ["GridSpec", "encodings", "grid"]
