"""Operators for preparing training text. Nothing else in vigil imports this subpackage."""
