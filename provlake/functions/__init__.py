"""Column functions: names, property values, times, text."""
