"""Keyed-table evolution and verification as Spark DataFrame plans."""
