"""Where recordings come from."""
