"""Generic relational and graph operators."""
