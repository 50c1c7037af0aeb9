"""Operators for preparing training data; nothing else in weft imports this."""
