"""Compositions of operators: the active-learning step and loop, replay, the
experiment grid, and the catalogue of registered queries with SQL twins."""
