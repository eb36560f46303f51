"""Column expressions and small per-batch kernels used inside the operators."""
