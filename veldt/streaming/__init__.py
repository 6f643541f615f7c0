"""Streams of query vectors against tables that stand still."""
