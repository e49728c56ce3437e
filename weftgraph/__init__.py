"""weftgraph: code-knowledge-graph and retrieval analytics on PySpark DataFrames."""
