"""Live views over run logs."""
