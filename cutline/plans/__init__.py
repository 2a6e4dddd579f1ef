"""Feature blocks, panels, projectors, evaluation, and the query catalogue."""
