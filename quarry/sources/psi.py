"""PageSpeed payloads: decoding, and the requests themselves one after another."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import store

# Names of the service's metrics.
LAB = {
    "largest-contentful-paint": "lcp_ms", "cumulative-layout-shift": "cls", "total-blocking-time": "tbt_ms",
    "first-contentful-paint": "fcp_ms", "speed-index": "speed_index_ms", "interactive": "tti_ms",
}
FIELD = {
    "LARGEST_CONTENTFUL_PAINT_MS": ("field_lcp_ms", 1.0), "CUMULATIVE_LAYOUT_SHIFT_SCORE": ("field_cls", 100.0),
    "INTERACTION_TO_NEXT_PAINT": ("field_inp_ms", 1.0), "FIRST_CONTENTFUL_PAINT_MS": ("field_fcp_ms", 1.0),
}


def decode(payloads: DataFrame) -> DataFrame:
    """(url .., payload) with the metrics as columns, null where they are missing."""
    v = F.try_parse_json("payload")
    number = lambda path: F.try_variant_get(v, path, "double")
    cols: dict[str, Column] = {"performance_score": number("$.lighthouseResult.categories.performance.score")}
    cols |= {name: number(f"$.lighthouseResult.audits['{k}'].numericValue") for k, name in LAB.items()}
    cols |= {name: number(f"$.loadingExperience.metrics.{k}.percentile") / by for k, (name, by) in FIELD.items()}
    cols["field_overall"] = F.try_variant_get(v, "$.loadingExperience.overall_category", "string")
    out = payloads.withColumns(cols)
    return out.withColumn("has_field_data", F.coalesce(*(F.col(n) for n, _ in FIELD.values())).isNotNull()).withColumn("score_pct", F.bround(F.col("performance_score") * 100).cast("int"))


def request(targets: DataFrame, get: Callable[[str], tuple[int, str]], gap: float = 1.5) -> DataFrame:
    """(url, payload, error) by get(url) -> (status, body), in one task: the service allows no more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url in b["url"]:
                payload, error = None, None
                for attempt in (0, 1):
                    try:
                        status, body = get(url)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        continue
                    finally:
                        time.sleep(gap)
                    if status == 200:
                        json.loads(body)
                        payload, error = body, None
                        break
                    error = f"HTTP {status}"
                    if attempt or status not in (429, 500, 503):
                        break
                rows.append((url, payload, error))
            yield pd.DataFrame(rows, columns=["url", "payload", "error"])

    store.prepare(targets.sparkSession)
    return targets.select("url").coalesce(1).mapInPandas(run, "url string, payload string, error string")
