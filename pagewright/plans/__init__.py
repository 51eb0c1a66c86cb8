"""Workflows over pages, and the registered queries."""
