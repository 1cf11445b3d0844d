"""corpusforge: catalog and corpus analytics expressed on Spark DataFrames."""
