"""Training-data operators: ten independent components over ``documents`` and friends.

Nothing outside this package imports it.  ``queries.QUERIES`` and
``queries.ORACLES`` hold the thin contract queries.
"""
