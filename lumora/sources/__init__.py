"""Interaction logs: tables, ratings files, a generative simulator."""
