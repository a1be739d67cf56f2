"""Operators of partwright."""
