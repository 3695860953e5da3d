"""Dashboard queries over events and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog import sqltext as q
from newsloom.catalog.base import register
from newsloom.operators import dashboards as db

FEED = "feed AS (SELECT event_id AS item_pos, user_id AS source, event_type AS category, ts AS published_at FROM events)"


def feed(t):
    return t.events.select(F.col("event_id").alias("item_pos"), F.col("user_id").alias("source"), F.col("event_type").alias("category"), F.col("ts").alias("published_at"))


@register("top_per_category", "W1", q.with_([FEED], """
SELECT category, source, item_pos, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY published_at DESC, source, item_pos) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY source, category ORDER BY item_pos) AS s FROM feed) WHERE s <= 2) WHERE rank <= 6"""))
def _(t):
    return db.per_category(feed(t)).select("category", "source", "item_pos", F.col("rank").cast("bigint").alias("rank"))


for _name, _per, _limit in [("latest_news", 2, 8), ("latest_announcements", 5, 8), ("latest_posts", 3, 10)]:
    register(_name, "W2", q.with_([FEED], f"""
SELECT source, item_pos FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY item_pos) AS s FROM feed) WHERE s <= {_per}
ORDER BY published_at DESC, source, item_pos LIMIT {_limit}"""))(lambda t, p=_per, n=_limit: db.newest_overall(feed(t), p, n).select("source", "item_pos"))


@register("paper_cards", "W3", q.with_([q.OK_ITEMS], f"""
SELECT id, {q.ellipsis('summary', 92)} AS display_title, id || CASE WHEN id % 4 = 0 THEN '' ELSE ' - ' || (id % 4) || ' upvotes' END AS meta FROM ok_items ORDER BY id LIMIT 8"""))
def _(t):
    votes = F.col("id") % 4
    rows = t.ok_items.withColumn("title", F.col("summary"))
    meta = [F.col("id").cast("string"), F.when(votes > 0, F.concat(votes.cast("string"), F.lit(" upvotes")))]
    return db.first_rows(db.with_meta(rows, 92, meta), ["id"]).select("id", "display_title", "meta")


@register("research_cards", "W3", q.with_([q.OK_ITEMS], f"""
SELECT id, branch, meta FROM (
  SELECT id, day, 0 AS branch, source_name AS meta FROM ok_items WHERE kind = 'fr'
  UNION ALL SELECT id, day, 1, kind || ' - ' || source_name FROM ok_items WHERE kind = 'de') ORDER BY day DESC, id LIMIT 8"""))
def _(t):
    single = db.with_meta(t.ok_items.filter("kind = 'fr'"), 96, [F.col("source_name")]).withColumn("branch", F.lit(0).cast("bigint"))
    listed = db.with_meta(t.ok_items.filter("kind = 'de'"), 96, [F.col("kind"), F.col("source_name")]).withColumn("branch", F.lit(1).cast("bigint"))
    return db.first_rows(single.unionByName(listed), [F.desc("day"), "id"]).select("id", "branch", "meta")


STUBS = "stubs AS (SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_id AS rank, event_type || '-' || event_id AS slug, event_type AS title, value FROM events WHERE value > 20)"
DAYS = "days AS (SELECT day, count(*) AS article_count, CAST(max(floor(value)) AS BIGINT) AS source_item_count, arg_min(slug, rank) AS lead_slug, arg_min(title, rank) AS lead_title FROM stubs GROUP BY day)"


def stubs(t):
    return t.events.filter(F.col("value") > 20).select(
        F.to_date("ts").cast("string").alias("day"), F.col("event_id").alias("rank"), F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("slug"),
        F.col("event_type").alias("title"), F.floor("value").cast("bigint").alias("source_items"))


@register("day_index", "A9", q.with_([STUBS, DAYS], "SELECT day, article_count, source_item_count, lead_slug, lead_title FROM days ORDER BY day DESC"))
def _(t):
    return db.day_index(stubs(t))


@register("picked_brief", "C6", q.with_([STUBS, DAYS], "SELECT day, article_count, lead_slug FROM days WHERE day = (SELECT max(day) FROM days)"))
def _(t):
    return db.pick_brief(db.day_index(stubs(t)), "2030-01-01").select("day", "article_count", "lead_slug")


@register("picked_current_brief", "C6", q.with_([STUBS, DAYS], "SELECT day, article_count, lead_slug FROM days WHERE day = '2024-01-07'"))
def _(t):
    return db.pick_brief(db.day_index(stubs(t)), "2024-01-07").select("day", "article_count", "lead_slug")


@register("static_paths", "C7", q.with_([STUBS], "SELECT day, slug FROM stubs"))
def _(t):
    rows = stubs(t).select("day", F.array(F.struct("slug", "title")).alias("stubs"))
    return db.static_paths(rows)
