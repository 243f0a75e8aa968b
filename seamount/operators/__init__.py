"""Index building, ranking, fusion, facets, graph and activity operators on DataFrames."""
