"""A retrieval, evaluation and corpus-processing engine on PySpark DataFrames."""
