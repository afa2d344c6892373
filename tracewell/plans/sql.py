"""One SQL text for Spark and for the checking engine: a few macros carry the differences of dialect."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: macro -> (Spark, checking engine); %s stands for the argument.
MACROS = {
    "us": ("unix_micros(CAST(%s AS timestamp))", "epoch_us(%s)"),
    "sha": ("sha2(%s, 256)", "sha256(%s)"),
    "idiv": ("CAST(floor(%s) AS bigint)", "CAST(floor(%s) AS bigint)"),
    "pct": ("percentile(%s)", "quantile_cont(%s)"),
    "numbers": ("explode(sequence(0, CAST(%s AS int) - 1))", "unnest(range(CAST(%s AS int)))"),
    "date": ("CAST(%s AS date)", "CAST(%s AS date)"),
    "text": ("CAST(%s AS string)", "CAST(%s AS varchar)"),
    "float": ("CAST(%s AS double)", "CAST(%s AS double)"),
    "long": ("CAST(%s AS bigint)", "CAST(%s AS bigint)"),
    "json": ("CAST(get_json_object(%s) AS bigint)", "CAST(json_extract_string(%s) AS bigint)"),
    "given": ("explode(array_compact(array(%s)))", "unnest(list_filter([%s], lambda r: r IS NOT NULL))"),
    "matches": ("regexp_like(%s)", "regexp_matches(%s)"),
    "finite": ("NOT isnan(%s)", "NOT isnan(%s)"),
    "backslash": ("char(92)%s", "chr(92)%s"),
    "hex": ("CAST(conv(%s, 16, 10) AS decimal(38, 0))", "CAST(CAST('0x' || %s AS bigint) AS decimal(38, 0))"),
    "count_if": ("count_if(%s)", "count_if(%s)"),
    "dot": ("aggregate(zip_with(%s, (p, q) -> CAST(p AS double) * q), CAST(0 AS double), (s, v) -> s + v)", "list_inner_product(%s)"),
    "item": ("get(%s)", "list_extract(%s + 1)"),
    "items": ("size(%s)", "len(%s)"),
    "gather": ("transform(array_sort(collect_list(struct(%s))), s -> s.m)", "list(m ORDER BY i)"),
    "largest": ("array_max(transform(%s, v -> abs(v)))", "list_max(list_transform(%s, lambda v: abs(v)))"),
    "minus": ("zip_with(%s, (p, q) -> p - q)", "list_transform(list_zip(%s), lambda z: z[1] - z[2])"),
    "scaled": ("transform(x, v -> v / nullif(most, 0))%s", "list_transform(x, lambda v: v / nullif(most, 0))%s"),
    "vec": ("transform(%s, v -> CAST(v AS double))", "CAST(%s AS double[])"),
}


def dialect(text: str, which: int) -> str:
    """Expand @macro(argument), innermost first."""
    while "@" in text:
        at = text.rindex("@")
        start = text.index("(", at)
        depth, end = 1, start
        while depth:
            end += 1
            depth += {"(": 1, ")": -1}.get(text[end], 0)
        text = text[:at] + MACROS[text[at + 1 : start]][which].replace("%s", text[start + 1 : end]) + text[end + 1 :]
    return text


def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(dialect(text, 0))

    return run


def both(texts: dict[str, str]) -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    return {k: query(v) for k, v in texts.items()}, {k: dialect(v, 1) for k, v in texts.items()}
