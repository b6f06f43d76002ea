"""quillgraph: documents to property graph analytics on Spark DataFrames."""
