"""Column expressions shared by the operators."""

from contrail.functions.columns import *  # noqa: F401,F403
