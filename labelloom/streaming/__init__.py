"""The annotation step on a stream of sentences."""
