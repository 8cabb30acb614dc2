"""Streaming use of the row-level steps.

The workload reads its input once and has no stream, watermark or state, so
no streaming operator is needed. The stateless steps (word rows, stop-word
anti join, word-table joins, polarity signs) work unchanged on a streaming
DataFrame; ``scored_words`` wires them to a stream of reviews, and the
per-review sums can be kept up to date with Spark's own streaming
aggregation (``update`` output mode), as ``review_sums`` does.
"""

from reviewlab.streaming.words import review_sums, scored_words  # noqa: F401
