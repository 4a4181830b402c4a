"""Text-triage analytics on Spark."""
