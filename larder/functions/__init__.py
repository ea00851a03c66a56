"""Scalar functions, JVM-side wherever a built-in expresses them."""
