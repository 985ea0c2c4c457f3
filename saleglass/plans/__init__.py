"""The registered queries by theme. They are loaded together and in order, whichever is asked for first."""

from saleglass import registry  # noqa: F401
