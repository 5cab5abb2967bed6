"""Feature marts and the query catalogue."""
