"""Whole jobs built from the operators: populations, places, jobs, links."""
