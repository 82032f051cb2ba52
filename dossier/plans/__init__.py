"""Compositions of the operators: the jobs a user runs."""
