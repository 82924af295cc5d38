"""Readers, writers and the test tables seen as bars, objects and logs."""
