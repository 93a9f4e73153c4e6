"""popweave: synthetic populations and record allocation as Spark jobs.

Aggregate count tables become one row per unit, and the units are linked to
each other and to places by seeded, reproducible merges.  Every operator takes
DataFrames and returns a DataFrame; Catalyst plans the work.
"""

from popweave.session import cut, local_session, scratch_path

__all__ = ["cut", "local_session", "scratch_path"]
