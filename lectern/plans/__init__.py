"""Planning reducers and the query catalogue."""
