"""Relational and graph operators over node and edge tables."""
