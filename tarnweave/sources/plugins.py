"""Plug-ins: embedding providers by name, metric and system registries, and a paged connector as a Spark data source.

Services behind a network (language models, speech, crawling) aren't part of the
library; their rows have these schemas, and a provider that reaches them can be
registered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnweave.operators.retrieval import hashed_embedding

FETCHED = "source_id string, url string, content binary, sha256 string, error string"
MEDIA = "file_id string, kind string, transcript string, ocr string, cues array<string>, error string"

_PROVIDERS: dict[str, Callable[[Column], Column]] = {"hashing-384": hashed_embedding}


def register_embedding(name: str, embed: Callable[[Column], Column]) -> None:
    """``embed`` maps a text column to a vector column, best as an Arrow UDF that loads its model once per worker."""
    _PROVIDERS[name] = embed


def embedding(name: str) -> Callable[[Column], Column]:
    if name not in _PROVIDERS:
        raise ValueError(f"no embedding provider {name!r}; known: {sorted(_PROVIDERS)}")
    return _PROVIDERS[name]


def metric_registry(spark: SparkSession, frameworks: Mapping[str, Sequence[tuple[str, str, float, float]]]) -> DataFrame:
    """(framework_id, metric_name, direction, scale_min, scale_max)."""
    rows = [(f, *m) for f, metrics in frameworks.items() for m in metrics]
    return spark.createDataFrame(rows, "framework_id string, metric_name string, direction string, scale_min double, scale_max double")


def system_flags(system: Column, switched_off: Mapping[str, Sequence[str]], flags: Sequence[str]) -> Column:
    """struct of booleans: which parts of the chain a system variant uses; variants that aren't listed use all."""
    table = F.create_map(*(x for k, v in switched_off.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))))
    off = F.coalesce(table[system], F.array().cast("array<string>"))
    return F.struct(*((~F.array_contains(off, f)).alias(f) for f in flags))


def dry_run(cases: DataFrame, system: str) -> DataFrame:
    """(case_id, system, response, latency_ms): replies that depend on the case alone, for runs without a model."""
    said = F.coalesce(F.try_element_at("turns", F.lit(-1)), F.lit(""))
    return cases.select("case_id", F.lit(system).alias("system"), F.concat(F.lit("dry-run:"), F.substring(F.sha2(F.concat_ws("\n", F.lit(system), said), 256), 1, 12)).alias("response"), F.lit(0).alias("latency_ms"))


class _Page(InputPartition):
    def __init__(self, source_id: str, url: str) -> None:
        self.source_id, self.url = source_id, url


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = dict(u.split("=", 1) for u in options.get("urls", "").split("\n") if "=" in u)
        self.fetch: str | None = options.get("fetcher")

    def partitions(self) -> Sequence[InputPartition]:
        return [_Page(k, v) for k, v in self.urls.items()] or [_Page("", "")]

    def read(self, partition: _Page) -> Iterator[tuple]:
        import hashlib
        from importlib import import_module

        if not partition.url:
            return
        if not self.fetch:
            yield partition.source_id, partition.url, None, None, "no fetcher given"
            return
        module, _, name = self.fetch.partition(":")
        try:
            content = getattr(import_module(module), name)(partition.url)
            yield partition.source_id, partition.url, content, hashlib.sha256(content).hexdigest(), None
        except OSError as e:
            yield partition.source_id, partition.url, None, None, str(e)[:200]


class FetchedPages(DataSource):
    """``spark.read.format("fetched")``: one task per URL of ``urls`` (lines ``id=url``), read by ``fetcher`` (``module:function``)."""

    @classmethod
    def name(cls) -> str:
        return "fetched"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def update_report(probes: DataFrame) -> DataFrame:
    """(ok, errors) of fetched rows."""
    return probes.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("errors"))
