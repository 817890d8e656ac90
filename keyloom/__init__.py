"""keyloom: path-keyed namespaces and their operators on Spark DataFrames."""
