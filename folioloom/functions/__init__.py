"""Scalar functions of the archive operators, as Column expressions."""

from .scalars import *  # noqa: F403
