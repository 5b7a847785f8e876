"""Flows over several operators, and the queries registered for checking."""
