"""Named queries over the driver's tables, each with the SQL that must agree with it where SQL can say it."""

from __future__ import annotations

import strandline.plans.note_queries  # noqa: F401
import strandline.plans.sequence_queries  # noqa: F401
import strandline.plans.text_queries  # noqa: F401
from strandline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
