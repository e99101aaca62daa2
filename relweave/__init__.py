"""Relational data synthesis, repair and quality scoring as Spark DataFrame operators."""
