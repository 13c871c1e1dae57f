"""Conversation-corpus analytics on Spark: every operator maps DataFrames to DataFrames."""
