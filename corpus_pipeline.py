"""From raw documents to shards: five stages, defined in ``tessera.llm.stages``."""

from __future__ import annotations

from tessera.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
