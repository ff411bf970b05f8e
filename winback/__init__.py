"""winback: customer-retention analytics on Spark DataFrames."""
