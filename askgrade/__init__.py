"""askgrade: question-quality text analytics on Spark DataFrames."""
