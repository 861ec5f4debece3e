"""Questions in natural language over a store: linking, grounding, candidate queries, answers."""
