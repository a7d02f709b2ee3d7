"""Runnable jobs over the given tables; each has a command line and a configuration file."""
