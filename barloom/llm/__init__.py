"""Operators for preparing training text at scale. Nothing else in barloom imports this subpackage."""
