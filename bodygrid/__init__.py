"""Anatomical cell and evidence analytics as PySpark DataFrame functions."""
