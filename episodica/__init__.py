"""Conversation-memory graphs as Spark jobs."""
