"""Registered queries with the SQL that checks them."""

from altertrace.queries import logs, model, reports, scores, search, traces  # noqa: F401
from altertrace.queries.base import REGISTRY  # noqa: F401
from altertrace.queries.reports import flagship  # noqa: F401
