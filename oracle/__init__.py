"""Independent SQL for a second engine: the expected result of every query that SQL can state."""
