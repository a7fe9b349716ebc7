"""Relational, graph and scoring operators over metadata tables."""
