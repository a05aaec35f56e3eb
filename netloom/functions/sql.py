"""The scalar functions for SQL users: SQL functions, no Python for each row."""

from __future__ import annotations

from pyspark.sql import SparkSession

_LABEL = "substring_index(x, '.', 1)"
_CHARS = "split({v}, '')"
_BITS = (
    "CASE WHEN length({v}) > 0 THEN log2(length({v})) - aggregate(transform(array_distinct(" + _CHARS + "), c -> "
    "CAST(size(filter(" + _CHARS + ", d -> d = c)) AS DOUBLE)), 0.0D, (a, n) -> a + n * log2(n)) / length({v}) ELSE 0.0D END"
)
_PARTS = "split(x, '[.]')"
_LOWER = "split(lower(x), '[.]')"
_SUB = f"CASE WHEN size({_LOWER}) > 2 THEN array_join(slice({_LOWER}, 1, size({_LOWER}) - 2), '') ELSE '' END"

#: name: (argument, result, expression of ``x``)
FUNCTIONS = {
    "label_entropy": ("STRING", "DOUBLE", f"round(coalesce({_BITS.format(v=_LABEL)}, 0.0D), 4)"),
    "consonant_ratio": ("STRING", "DOUBLE", f"round(CASE WHEN length({_LABEL}) > 0 THEN length(regexp_replace(lower({_LABEL}), '[^bcdfghjklmnpqrstvwxyz]', '')) / length({_LABEL}) ELSE 0.0D END, 3)"),
    "dga_score": (
        "STRING", "DOUBLE",
        f"coalesce(round(least(CASE WHEN label_entropy(x) > 3.5 THEN 0.4D ELSE 0.0D END + CASE WHEN consonant_ratio(x) > 0.65 THEN 0.3D ELSE 0.0D END"
        f" + CASE WHEN length({_LABEL}) > 12 THEN 0.2D ELSE 0.0D END + CASE WHEN length({_LABEL}) > 20 THEN 0.1D ELSE 0.0D END, 1.0D), 3), 0.0D)",
    ),
    "base_domain": ("STRING", "STRING", "lower(substring_index(x, '.', -2))"),
    "subdomain": ("STRING", "STRING", _SUB),
    "subdomain_entropy": ("STRING", "DOUBLE", f"round({_BITS.format(v='subdomain(x)')}, 4)"),
    "mean_label_length": ("STRING", "DOUBLE", f"round(aggregate({_PARTS}, 0, (a, p) -> a + length(p)) / size({_PARTS}), 2)"),
    "longest_label": ("STRING", "INT", f"array_max(transform({_PARTS}, p -> length(p)))"),
    "text_entropy": ("STRING", "DOUBLE", f"round(coalesce({_BITS.format(v='lower(x)')}, 0.0D), 4)"),
    "ip_to_long": ("STRING", "BIGINT", f"CASE WHEN size({_PARTS}) = 4 AND forall({_PARTS}, p -> coalesce(try_cast(p AS BIGINT) BETWEEN 0 AND 255, false)) THEN aggregate({_PARTS}, 0L, (a, p) -> a * 256 + try_cast(p AS BIGINT)) END"),
    "is_ip_name": ("STRING", "BOOLEAN", "regexp_like(x, '^[0-9.]+$')"),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Creates the functions for this session; ``prefix`` keeps them from others' names.
    Returns their names."""
    for name, (argument, result, body) in FUNCTIONS.items():
        for other in FUNCTIONS:
            body = body.replace(f"{other}(", f"{prefix}{other}(")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x {argument}) RETURNS {result} RETURN {body}")
    return [f"{prefix}{n}" for n in FUNCTIONS]
