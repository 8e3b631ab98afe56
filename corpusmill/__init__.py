"""corpusmill: text-corpus preparation, retrieval and evaluation on Spark DataFrames."""
