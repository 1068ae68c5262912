"""From documents to DataFrames: language, selections, predicates, planner."""
