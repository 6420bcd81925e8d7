"""Operators that prepare training corpora; nothing else in the library imports this subpackage."""
