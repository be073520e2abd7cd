"""Operators for preparing training text and vectors; nothing else of the library imports this subpackage."""
