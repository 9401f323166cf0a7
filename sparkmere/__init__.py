"""sparkmere: building and evaluating text-retrieval datasets with Spark DataFrames."""
