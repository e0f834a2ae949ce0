"""Structured Streaming: tokenizing and scoring as stateless stream stages."""
