"""Whole jobs made of operators, and the queries registered for the driver."""
