"""Operators for building training corpora; nothing else in netloom imports this subpackage."""
