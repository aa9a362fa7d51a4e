"""Training-data operators. Nothing outside this package imports it, except the guarded entry file."""
