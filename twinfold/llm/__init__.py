"""Operators for preparing training data; nothing else in twinfold imports this subpackage."""
