"""Graph-pattern algebra, its compiler and the text front end."""
