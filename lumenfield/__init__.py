"""Spark-native catalogue, frame-selection and image-stack operators for astrophotography."""

__version__ = "0.1.0"
