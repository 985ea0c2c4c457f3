"""Keyed merges over Parquet tables: the new state is a join of target and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, chosen in partial aggregates."""
    last = F.max_by(F.struct(*rows.columns), F.struct(order)).alias("_row")
    return rows.groupBy(F.col(key).alias("_key")).agg(last).select("_row.*")


def merge(target: DataFrame, source: DataFrame, key: str, choose: dict[str, Column]) -> DataFrame:
    """Full outer join on ``key``. ``choose`` gives a column from ``t`` (target) and ``s`` (source) fields where both
    rows are there; other columns take the source's. Rows on one side only stay as they are."""
    t = target.select(F.col(key).alias("_kt"), F.struct(*target.columns).alias("t"))
    s = source.select(F.col(key).alias("_ks"), F.struct(*target.columns).alias("s"))
    both = t.join(s, F.col("_kt") == F.col("_ks"), "full_outer")
    matched = F.col("_kt").isNotNull() & F.col("_ks").isNotNull()
    return both.select(*(F.when(matched, choose.get(c, F.col(f"s.{c}"))).when(F.col("_ks").isNull(), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in target.columns))


def upsert_sales(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Volatile columns follow the batch's last row; origin stays; a price found for an offer is kept."""
    found = F.col("t.offer_status") == "found"
    keep = {c: F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")) for c in ("query_id", "sport") if c in target.columns}
    keep |= {"price_cents": F.when(found, F.col("t.price_cents")).otherwise(F.col("s.price_cents")), "best_offer": F.when(found, F.lit(1)).otherwise(F.col("s.best_offer")), "offer_status": F.coalesce("t.offer_status", "s.offer_status"), "ask_cents": F.coalesce("t.ask_cents", "s.ask_cents")}
    return merge(target, last_by(batch, "item_id", "seq"), "item_id", keep)


def record_offers(sales: DataFrame, offers: DataFrame) -> DataFrame:
    """``offers`` (item_id, status, accepted_cents): found ones move the price to the ask; found rows never change."""
    both = sales.join(offers, "item_id", "left")
    open_ = F.coalesce("offer_status", F.lit("")) != "found"
    got = F.coalesce(open_ & (F.col("status") == "found"), F.lit(False))
    return both.withColumns({
        "ask_cents": F.when(got, F.coalesce("ask_cents", "price_cents")).otherwise(F.col("ask_cents")),
        "price_cents": F.when(got, F.col("accepted_cents")).otherwise(F.col("price_cents")),
        "offer_status": F.when(open_ & F.col("status").isNotNull(), F.col("status")).otherwise(F.col("offer_status")),
    }).drop("status", "accepted_cents")


def record_segments(target: DataFrame, again: DataFrame) -> DataFrame:
    """A repeat of a retrying segment adds its pages and items; any other replaces."""
    retry = F.col("t.status") == "retrying"
    add = {c: F.when(retry, F.col(f"t.{c}") + F.col(f"s.{c}")).otherwise(F.col(f"s.{c}")) for c in ("pages", "items")}
    return merge(target, again, "id", add)
