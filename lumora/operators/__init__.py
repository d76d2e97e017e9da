"""Dataset and evaluation operators."""
