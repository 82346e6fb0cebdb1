"""The questions callers ask, one function each: tables and filters in, a lazy DataFrame out.

Filters left out add no predicate. `tables` maps table names to DataFrames; each
module says which columns it reads.
"""
