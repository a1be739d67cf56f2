"""Functions of partwright."""
