"""Iterative drivers, registered queries and the command line."""
