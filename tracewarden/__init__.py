"""Agent-activity security and audit analytics on Spark DataFrames."""
