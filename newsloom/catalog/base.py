"""Table access, adapter views and the query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.functions import html as hx, text as tx, urls as ux
from newsloom.schemas import TABLES
from newsloom.session import configure, spread_small

# Words that are frequent in the given corpus; the term-driven queries take
# these, since the fixed lists are about another subject.
CORPUS_TERMS = ["thing", "there", "tion", "with", "that", "from"]
CORPUS_ENTITIES = [("ther", "Ther"), ("tion the", "Tion The"), ("eau", "Eau"), ("ung", "Ung"), ("cion", "Cion"), ("and", "And")]

EVENT_STATUS = {"signup": "discovered", "view": "parsed", "click": "briefed", "purchase": "enriched",
                "error": "revisit_pending"}


class Tables:
    """The given tables and the adapter views built from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = str(sf_dir).rstrip("/")

    def read(self, name: str, *keys: str) -> DataFrame:
        df = self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        return spread_small(df, *keys) if keys else df

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents", "doc_id")

    @cached_property
    def pages(self) -> DataFrame:
        return self.read("pages", "page_id")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def items(self) -> DataFrame:
        """Documents as feed items."""
        labels = self.read("labels").select("doc_id", "quality")
        body = tx.collapse(F.col("text"))
        day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
        return (
            self.documents.select("doc_id", "text", "lang", "source")
            .join(labels, "doc_id", "left")
            .select(
                F.col("doc_id").alias("id"),
                F.col("source").alias("source_name"),
                F.col("lang").alias("kind"),
                F.substring_index(body, " ", 8).alias("title"),
                body.alias("summary"),
                F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
                day.alias("day"),
                F.array("lang", "source").alias("tags"),
                F.when(F.col("quality") == 0, "error").otherwise("ok").alias("status"),
            )
        )

    @cached_property
    def ok_items(self) -> DataFrame:
        return self.items.filter(F.col("status") == "ok")

    @cached_property
    def page_links(self) -> DataFrame:
        """Every anchor of every page, resolved."""
        href = hx.attribute_values(F.col("html"), "a", "href")
        return self.pages.select(
            "page_id", F.col("url").alias("page_url"), F.posexplode(href).alias("pos", "href")
        ).select(
            "page_id", "page_url", (F.col("pos") + 1).cast("bigint").alias("pos"), "href",
            ux.resolve(F.col("href"), F.col("page_url")).alias("url"),
        )

    @cached_property
    def ledger(self) -> DataFrame:
        """Events as an append-only ledger."""
        status = F.lit("discovered")
        for event, state in EVENT_STATUS.items():
            status = F.when(F.col("event_type") == event, state).otherwise(status)
        return self.events.select(
            F.col("event_id").alias("seq"), F.col("user_id").alias("id"), status.alias("status"),
            F.col("ts").alias("observed_at"), F.col("value").alias("score"), "event_type", "props",
        )

    @cached_property
    def turns(self) -> DataFrame:
        return self.read("conversations", "conv_id")

    @cached_property
    def search_queries(self) -> DataFrame:
        return self.read("benchmark").select(F.col("item_id").alias("query_id"), "text")


@dataclass(frozen=True)
class Entry:
    name: str
    covers: tuple[str, ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, covers: str, sql: str | None = None):
    """Bind a function of the tables to a query name."""

    def bind(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(name, tuple(covers.split()), fn, sql)
        return fn

    return bind
