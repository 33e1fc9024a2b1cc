"""vellum: document and fact analytics expressed as Spark DataFrames."""
