"""A stream of words through a fixed cascade. An extension: a rule looks at one word, so the stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from phonoweave.operators.engine import apply_cascade
from phonoweave.sources.readers import Cascade


def stream_cascade(words: DataFrame, cascade: Cascade, form: str = "form") -> DataFrame:
    """A streaming DataFrame with outcome added to each row."""
    if not words.isStreaming:
        raise ValueError("not a stream")
    return apply_cascade(words, cascade, form)
