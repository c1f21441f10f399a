"""Operators for large training collections. Nothing outside this folder imports it."""
