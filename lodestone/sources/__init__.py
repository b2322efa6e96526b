"""The sources of the engine."""
