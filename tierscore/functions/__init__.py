"""Column functions: binning, rank and segment-key expressions, small scalar helpers."""
