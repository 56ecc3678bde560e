"""Scalar, aggregate and table functions that scripts can create and use."""
