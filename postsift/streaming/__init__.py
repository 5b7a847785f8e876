"""Structured Streaming forms of the stateful steps, with their batch twins."""
