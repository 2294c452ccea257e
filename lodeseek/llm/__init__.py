"""Training-data operators: dedup, scoring, scanning, mixing, counting, packing, search.

Nothing outside this subpackage imports it. The operators take DataFrames with the
columns they name, keep to those columns (so extra columns never clash) and give
every null, empty, tied or repeated row the result their docstring states.
"""
