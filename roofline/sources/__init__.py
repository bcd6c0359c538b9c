"""Scans and extraction."""
