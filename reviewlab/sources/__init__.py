"""Sources: the review CSV scan, the driver's parquet tables, the word-table
stand-ins, and schema/summary listings."""

from reviewlab.sources.csv import REVIEW_COLUMNS, REVIEW_SCHEMA, read_reviews  # noqa: F401
from reviewlab.sources.fixtures import (  # noqa: F401
    Lexicons,
    lexicons,
    read_table,
    reviews,
    vocab,
)
from reviewlab.sources.schema import describe_schema, level_counts, summarise  # noqa: F401
