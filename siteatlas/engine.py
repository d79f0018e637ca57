"""One entry to the engine's operators: every call takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteatlas.functions.html import page_records
from siteatlas.functions.markdown import parsed
from siteatlas.operators import changes, crawl, decisions, grading, guides, jobs, validation
from siteatlas.operators.ranking import bm25
from siteatlas.operators.reconcile import reconcile


class Fetcher(Protocol):
    """Gives captures (url, status, content_type, body) for URLs; the default looks them up in a table."""

    def __call__(self, wanted: DataFrame) -> DataFrame: ...


class Assessor(Protocol):
    """Gives a plan (site, url, step) for candidates (site, url); what isn't fit is refused by site, and the ranked order stands in."""

    def __call__(self, candidates: DataFrame) -> DataFrame: ...


class Completer(Protocol):
    """Gives results for requests, one Arrow batch at a time; the default is the baseline that needs no model."""

    def __call__(self, requests: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


class Engine:
    def __init__(self, spark: SparkSession, fetcher: Fetcher | None = None, completer: Completer | None = None, assessor: Assessor | None = None):
        self.spark, self.fetcher, self.completer, self.assessor = spark, fetcher, completer, assessor

    def fetch(self, wanted: DataFrame, captures: DataFrame | None = None) -> DataFrame:
        if self.fetcher:
            return self.fetcher(wanted)
        if captures is None:
            raise ValueError("without a fetcher, captures must be given")
        return crawl.replayed(wanted, captures, "unavailable")

    def extract(self, captures: DataFrame, body: str = "html", url: str = "url") -> DataFrame:
        return page_records(captures, body, url)

    def crawl(self, pages: DataFrame, max_pages: int, text_budget: int, plan: DataFrame | None = None) -> DataFrame:
        return crawl.crawled(pages, max_pages, text_budget, plan)

    def plan(self, pages: DataFrame, candidates: DataFrame) -> DataFrame:
        """The assessor's plan for each site where it is fit, else the ranked order."""
        ranked = crawl.read_order(pages)
        plan = self.assessor(candidates) if self.assessor else ranked.select("site", "url", F.col("place").alias("step")).limit(0)
        return crawl.checked_plan(plan, candidates, ranked)

    def reconcile(self, stored: DataFrame, observed: DataFrame) -> DataFrame:
        return reconcile(stored, observed)

    def inbox(self, draft: DataFrame, latest: DataFrame, links: DataFrame, flagged: DataFrame) -> DataFrame:
        return changes.inbox(changes.source_changes(draft, latest), links, flagged)

    def generate(self, requests: DataFrame, schema: str | None = None) -> DataFrame:
        """requests in rows of sources for the baseline, of whatever the completer reads otherwise."""
        return requests.mapInPandas(self.completer, schema) if self.completer else guides.baseline(requests)

    def validate(self, results: DataFrame) -> DataFrame:
        return validation.validated(results)

    def parse(self, texts: DataFrame, text: str = "text", base: str = "base") -> DataFrame:
        return texts.withColumn("parsed", parsed(text, base))

    def render(self, guides_: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
        return guides.rendered(guides_, links, sources)

    def link(self, guides_: DataFrame, children: DataFrame, kept: DataFrame) -> DataFrame:
        return guides.linked(guides_, children, kept)

    def publish(self, requests: DataFrame, projects: DataFrame, versions: DataFrame, active: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
        return decisions.published(projects, decisions.publish_gate(requests, projects, versions, active, answers), now)

    def claim(self, table: DataFrame, now: Column, workers: int) -> DataFrame:
        return jobs.claimed(table, now, workers)

    def rank(self, queries: DataFrame, documents: DataFrame, k: int = 3) -> DataFrame:
        return bm25(queries, documents, k)

    def grade(self, rows: DataFrame, grade: Callable[[], Column] = grading.routing) -> DataFrame:
        return rows.withColumn("grade", grade())

    def summarize(self, graded: DataFrame, *by: str) -> DataFrame:
        return grading.routing_summary(graded, *by)
