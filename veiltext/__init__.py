"""Document cleansing and analysis on Spark DataFrames."""
