"""Evidence-inventory operators and plans for Spark DataFrames."""
