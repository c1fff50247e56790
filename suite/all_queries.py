"""Import every query module so that it registers itself."""

import suite.text_queries  # noqa: F401
import suite.chunk_queries  # noqa: F401
import suite.layout_queries  # noqa: F401
import suite.catalog_queries  # noqa: F401
import suite.retrieval_queries  # noqa: F401
import suite.tree_queries  # noqa: F401
import suite.source_queries  # noqa: F401
