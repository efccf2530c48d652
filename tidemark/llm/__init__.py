"""Operators for preparing training data at scale. Nothing else in tidemark imports this subpackage."""
