"""Checks, profiles, registers, groups and metrics."""
