"""Streams over the operation log and the journal. Extensions: the log as a change feed."""
