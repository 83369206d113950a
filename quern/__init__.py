"""quern: set-at-a-time knowledge and corpus analytics on Spark DataFrames."""
