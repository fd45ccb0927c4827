"""Shared physical building blocks: seeded order, cuts, ranks, prefix sums, block grids."""
