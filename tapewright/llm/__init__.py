"""Training-data operators: each module holds one operator, ``queries`` the
thin contract queries built on them.  Nothing outside this package imports it."""
