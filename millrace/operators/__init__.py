"""Graph, model and aggregation operators over DataFrames."""
