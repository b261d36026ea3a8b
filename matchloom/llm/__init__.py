"""Operators for training data: matching, unifying, mapping, leak search, mixing and levels of text."""
