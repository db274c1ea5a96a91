"""Strandloom: interval, sequence, set and enrichment analytics on Spark DataFrames.

Every operator takes DataFrames or Columns and returns DataFrames or Columns;
nothing runs until the caller writes or collects. The few operators that have to
cut lineage (range-sorted scans, iterative graphs) do so with ``checkpoint()`` or
a written table in the shared folder named by ``spark.checkpoint.dir``.
"""

__version__ = "0.1.0"
