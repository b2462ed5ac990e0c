"""Whole jobs built from the operators, and the driver tables seen as submissions."""
