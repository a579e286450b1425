"""Operators for large-scale language-model training data. Nothing outside this package imports it."""
