"""Column expressions: element-wise math, activations, vectors and text."""
