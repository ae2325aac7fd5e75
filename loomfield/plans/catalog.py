"""Every query of the engine by name, with its oracle SQL."""

from loomfield.plans import html_queries, io_queries, learning_queries, page_queries, record_queries, site_queries, stat_queries, stream_queries, text_queries  # noqa: F401
from loomfield.plans.registry import QUERIES, SQL  # noqa: F401
