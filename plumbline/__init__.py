"""Data-quality checks, run history and similarity search as Spark jobs.

Every public function takes DataFrames and parameters and gives a DataFrame
back.  Nothing reads the clock: the moment a check is judged at is always a
parameter called ``as_of``.
"""

__version__ = "0.1.0"
