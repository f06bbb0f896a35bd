"""Functions for SQL text: ``register(spark)`` makes them known to a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from marginalia.functions import similarity, text


def register(spark: SparkSession) -> list[str]:
    """norm_event_text, fold_text, accent_free and seq_ratio by Arrow; token_jaccard and address_key as SQL expressions."""
    spark.udf.register("norm_event_text", text.normalize_event_text)
    spark.udf.register("fold_text", text.fold)
    spark.udf.register("accent_free", text.accent_free)
    spark.udf.register("seq_ratio", similarity.sequence_ratio)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION token_jaccard(a STRING, b STRING) RETURNS DOUBLE RETURN "
        "CASE WHEN size(array_union(split(a, ' '), split(b, ' '))) > 0 THEN size(array_intersect(split(a, ' '), split(b, ' '))) / size(array_union(split(a, ' '), split(b, ' '))) ELSE 0 END"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION collapse_text(a STRING) RETURNS STRING RETURN trim(regexp_replace(a, '\\\\s+', ' '))")
    return ["norm_event_text", "fold_text", "accent_free", "seq_ratio", "token_jaccard", "collapse_text"]
