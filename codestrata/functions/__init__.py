"""Part of the codestrata analytics engine."""
