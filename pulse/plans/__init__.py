"""Multi-step jobs (rollups, corpus refresh) and the query catalog."""
