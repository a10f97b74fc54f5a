"""Usage-telemetry analytics as Spark DataFrame operators.

Every operator takes DataFrames plus column names and returns a DataFrame. Nothing in the library
collects rows to the driver; the two places that run an action while building a plan (the convergence
test of the connected-components loop and the guards of the report tables) fetch one row.
"""

__version__ = "0.1.0"
