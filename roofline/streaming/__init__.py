"""The poll cycle as a Structured Streaming query."""
