"""Sedgeline: training-data and evaluation analytics as Spark plans.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is computed before an action asks for it, save where an
operator is iterative and says so.
"""

__version__ = "0.1.0"
