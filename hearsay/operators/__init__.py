"""DataFrame -> DataFrame operators.

All are lazy, but for two bounded look-aheads: the size check of a lookup table
and the fit of a topic model.
"""
