"""Operators of a training-data pipeline; one module per operator, each with a
general interface, and ``queries`` with the registered queries."""
