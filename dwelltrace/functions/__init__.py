"""Scalar building blocks. Each takes and returns ``Column``; none is a Python UDF."""
