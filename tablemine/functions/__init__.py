"""Shared distributed primitives and special functions."""
