"""Threadline: session-transcript analytics written as Spark DataFrame jobs."""
