"""Column kernels: geometry, rounding, money, projection."""
