"""DataFrame to DataFrame operators keyed by series and time."""
