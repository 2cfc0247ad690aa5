"""Columnar compute operators as DataFrame and Catalyst expressions, for clusters of any size."""
