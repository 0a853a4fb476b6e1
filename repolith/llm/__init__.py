"""Operators of a training-data pipeline over large document tables; nothing else in the library imports them."""
