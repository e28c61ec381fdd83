"""Crawler output: one JSON object per URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescan import schemas
from lurescan.functions import constants as C
from lurescan.operators.page_features import default_page_features


def parse_crawl_output(df: DataFrame, output: str = "stdout", code: str = "exit_code") -> DataFrame:
    """Replace the output by the page features, url, requested_url and error_reason.

    Broken JSON, a failed crawl and a dead page all give the default features and keep the
    requested url; a live page gives its own url.
    """
    record = F.from_json(F.col(output), schemas.crawl_record())
    parsed = df.withColumn("_page", F.when(F.col(code) == 0, record))
    alive = F.coalesce(F.col("_page.is_alive") == 1, F.lit(False))
    features = {"is_alive": alive.cast("int")}
    for name, default in default_page_features().items():
        if name != "is_alive":
            field = F.col(f"_page.{C.CRAWL_FIELD_NAMES.get(name, name)}")
            features[name] = F.when(alive, F.coalesce(field, F.lit(float(default)))).otherwise(
                F.lit(float(default))
            )
    features["punctuation_density"] = F.when(alive, F.col("_page.punctuation_density")).otherwise(0.0)
    return parsed.withColumns(
        features
        | {
            "requested_url": F.col("url"),
            "url": F.when(alive, F.coalesce("_page.url", "url")).otherwise(F.col("url")),
            "error_reason": F.col("_page.error_reason"),
        }
    ).drop("_page", output, code)
