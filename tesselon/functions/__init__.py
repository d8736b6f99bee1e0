"""Scalar and aggregate functions as Column expressions; none runs Python on the executors."""
