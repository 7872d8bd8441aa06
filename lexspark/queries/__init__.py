"""Queries over the driver tables, each with SQL that DuckDB answers alike.

The reference's own data are statutes that aren't here, so each query runs an operator's
semantics on the tables at hand; its docstring names the operator by its survey ID.
"""
