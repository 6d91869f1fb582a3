"""Supervisory review of security-operations work as Spark DataFrame jobs."""
