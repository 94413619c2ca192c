"""commutelens: who can reach which jobs by public transport, computed on Spark.

Every operator takes DataFrames and returns DataFrames.  Scalars (a threshold, a
budget, a total) stay one-row DataFrames and enter other plans as scalar
subqueries, so no operator collects data on the driver.
"""
