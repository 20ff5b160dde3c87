"""Pure NumPy kernels: arrays in, arrays out, no Spark. The operators call them inside Arrow batches."""
