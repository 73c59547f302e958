"""Registered jobs: each binds operators to inputs and gives the same in SQL."""
