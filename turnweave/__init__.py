"""Conversation-interaction analytics expressed as Spark DataFrame jobs."""
