"""quillspark: text knowledge bases, retrieval and conversation analytics on Spark DataFrames."""
