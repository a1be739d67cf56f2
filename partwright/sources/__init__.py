"""Sources of partwright."""
