"""Recommenders: fit on a dataset, score evaluation rows."""
