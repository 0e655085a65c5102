"""Operators for large-scale training-text preparation.

One module per problem; ``queries`` wires them to the driver's tables.  Nothing
outside this package imports it.
"""
