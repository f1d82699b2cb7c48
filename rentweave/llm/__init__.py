"""Operators for building language-model training data. Nothing outside this folder imports it."""
