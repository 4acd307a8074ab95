"""Operators that prepare training text; nothing else in plinth imports this subpackage."""
