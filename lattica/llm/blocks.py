"""The grid of blocks, which searches of the core use too."""

from lattica.operators.blocks import bounds, by_tile, matrices, merged, tiles, usable  # noqa: F401
