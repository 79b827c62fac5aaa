"""Training-data operators: filters, near-duplicate search, sharding, token files and packing.

Nothing outside this subpackage imports it; ``queries`` registers one thin query per operator.
"""
