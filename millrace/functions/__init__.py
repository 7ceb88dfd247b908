"""Column builders: vectors and character codes."""
