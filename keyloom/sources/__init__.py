"""Stored namespaces and recovery journals."""
