"""reviewlab: review analytics as Spark DataFrame jobs.

Every public function takes Spark DataFrames (or columns) and returns a
DataFrame (or a column expression); row-level work runs on executors.
"""

__version__ = "0.1.0"
