"""All queries and their SQL; importing the modules registers them."""

from . import expressions, extraction, relational  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
