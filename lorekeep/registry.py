"""Every query of the library by name, with its SQL where SQL can say it."""

from __future__ import annotations

from .plans import documents, knowledge, rollups, searches, texts, transcripts  # noqa: F401  they register their queries
from .plans.base import QUERIES, SQL  # noqa: F401
