"""Column-level building blocks. Everything here returns a ``Column``."""
