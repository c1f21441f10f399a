"""Query trees, their compilation to columns, and the catalogue of queries."""
