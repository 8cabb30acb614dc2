"""Column expressions (JVM-side, codegen-friendly)."""

from reviewlab.functions.columns import (  # noqa: F401
    AGE_BANDS,
    TOKEN_PATTERN,
    age_band,
    argmax,
    hex_hash,
    hit,
    one_hot,
    polarity_sign,
    rating_band,
    shift_label,
    to_number,
)
