"""Knowledge graphs from text tables, as Spark DataFrame jobs.

Every operator takes and returns DataFrames. Nothing here holds a session or
starts a job on import.
"""
