"""Behaviour-trace analytics expressed as Spark DataFrame operators."""
