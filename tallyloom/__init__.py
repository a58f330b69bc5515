"""tallyloom: count- and molecule-level analytics as plain Spark DataFrame operators."""

__version__ = "0.1.0"
