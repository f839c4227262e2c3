"""Order-flow and limit-order-book analytics on Spark DataFrames."""
