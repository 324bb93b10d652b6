"""Operators of a training-corpus pipeline over document, page and conversation tables."""
