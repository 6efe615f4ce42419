"""strandlake: pangenome analytics and training-data operators on Spark DataFrames."""
