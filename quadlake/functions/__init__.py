"""Column functions over term keys."""
