"""Programs: the order of steps, and all reading and writing."""
