"""From raw documents to token ids: the stages of regtext.llm.stages, each a function of (spark, docs, sf_dir)."""

from regtext.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
