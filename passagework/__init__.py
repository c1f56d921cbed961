"""passagework: document search and corpus processing on Spark DataFrames."""
