"""Conversation and knowledge analytics as PySpark DataFrame operators."""
