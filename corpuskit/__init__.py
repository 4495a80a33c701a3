"""corpuskit: corpus-scale text retrieval operators on Spark DataFrames.

Every operator is a plain function from DataFrame(s) to DataFrame, meant to be
chained with ``DataFrame.transform``.  Nothing here holds state, and nothing
pulls a data-sized result to the driver.
"""
