"""Column functions: geometry, decay kernels, labels and clock times."""
