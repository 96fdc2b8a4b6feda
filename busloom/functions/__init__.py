"""Column functions: bit fields, times and renderings. Built-in expressions only."""
