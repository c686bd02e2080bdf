"""All registered queries; importing the topic modules fills the registry."""

from labelmill.plans import (  # noqa: F401
    eval_queries,
    label_queries,
    log_queries,
    merge_queries,
    model_queries,
    sample_queries,
    text_queries,
)
from labelmill.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
