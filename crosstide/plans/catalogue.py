"""All registered queries, in one import."""

from crosstide.plans import (  # noqa: F401
    evaluation_queries, experiment_queries, feature_queries, file_queries, graph_queries, section_queries)
from crosstide.plans.evaluation_queries import flagship  # noqa: F401
from crosstide.plans.registry import QUERIES  # noqa: F401
