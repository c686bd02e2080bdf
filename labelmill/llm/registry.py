"""All queries of this subpackage, the pipeline among them."""

import corpus_pipeline
from labelmill.llm import more_queries, queries

LLM_QUERIES, LLM_SQL = {**queries.QUERIES, **more_queries.QUERIES, "pipeline": corpus_pipeline.run}, {**queries.SQL, **more_queries.SQL}
if corpus_pipeline.ORACLE_SQL:
    LLM_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
