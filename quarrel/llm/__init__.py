"""Training-data operators: private data, packing, token files, mixing, duplicates, search, quality.

Nothing outside this subpackage imports it. `queries.py` binds each operator to the driver's tables.
"""
