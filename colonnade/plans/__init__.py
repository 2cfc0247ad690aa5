"""Queries that apply the operators to the supplied tables, and their SQL."""
