"""Streaming of partwright."""
