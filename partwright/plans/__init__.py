"""Plans of partwright."""
