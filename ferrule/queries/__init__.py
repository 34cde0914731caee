"""All named queries of the engine and their SQL twins."""

from . import functions, programs, recursive, relational  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401
