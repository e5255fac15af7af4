"""Typed tensor-pipeline data work as PySpark DataFrame operators."""
