"""Relational, spatial, hierarchical and graph operators over DataFrames."""
