"""Whole workflows, their records and the command line."""
