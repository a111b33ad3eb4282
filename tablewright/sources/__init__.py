"""Saved tables and views."""
