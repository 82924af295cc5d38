"""Operators over bar tables, object listings and logs."""
