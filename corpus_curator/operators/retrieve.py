"""Join sampled ids back to the full records."""

from __future__ import annotations

from pyspark.sql import DataFrame


def retrieve_by_uuid(ids: DataFrame, corpus: DataFrame, key: str = "uuid",
                     how: str = "left") -> DataFrame:
    """Records of the sampled ids.

    ``how="left"`` keeps every id: unknown ids get null columns, duplicate
    corpus keys multiply rows (a left join from the ids). ``how="semi"``
    returns the corpus rows whose key was sampled, each once. One join; Spark
    picks the build side by size and splits a skewed key; a corpus bucketed by
    ``key`` is not shuffled.
    """
    ids = ids.select(key)
    if how == "semi":
        return corpus.join(ids, key, "left_semi")
    return ids.join(corpus, key, how)
