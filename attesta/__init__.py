"""attesta: evidence-backed claims as Spark tables.

Documents, pages, conversations and operational tables become subject-predicate-object claims with evidence.
Every operator takes and returns DataFrames, so Catalyst sees one plan from the scan to the result.
"""

from attesta.config import Settings
from attesta.session import build_session, cut_lineage

__all__ = ["Settings", "build_session", "cut_lineage"]
