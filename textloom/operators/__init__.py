"""Operators on DataFrames: matching, grouping, coverage, catalog, glossary, versions and work lists."""
