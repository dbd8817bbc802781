"""Evidence-ledger analytics as plain Spark DataFrame code.

Every public operator is a function from DataFrames to a DataFrame: no session
singleton, no cached state, no driver-side loop over rows.
"""
