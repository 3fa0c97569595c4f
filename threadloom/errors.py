"""Exceptions raised on the driver for invalid configuration."""


class ThreadloomError(Exception):
    """Any failure of this library."""


class ConfigurationError(ThreadloomError, ValueError):
    """An option has a value that cannot be used."""
