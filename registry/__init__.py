"""Queries on the test tables, each next to the SQL that checks it."""

from .base import QUERIES, SQL  # noqa: F401
from . import baseball, models, relational  # noqa: F401
