"""Posts, likes, comments, friends, experience and badges."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.data import badges as fixed
from tessella.functions.bounds import fixed_table
from tessella.operators import habits as hb


def badge_table(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, fixed.BADGES,
                       "badge_id string, category string, rarity string, type string, target int")


def likes(like_events: DataFrame) -> DataFrame:
    """Who likes what now: the last of like and unlike per (post, user); of equal
    times the larger value, hence the like."""
    return (like_events.groupBy("post_id", "user_id")
            .agg(F.max(F.struct("ts", "liked"))["liked"].alias("liked")).where("liked")
            .select("post_id", "user_id"))


def post_counters(posts: DataFrame, like_events: DataFrame, comments: DataFrame) -> DataFrame:
    n_likes = likes(like_events).groupBy("post_id").agg(F.count("*").alias("l"))
    n_comments = comments.groupBy("post_id").agg(F.count("*").alias("c"))
    return (posts.join(n_likes, "post_id", "left").join(n_comments, "post_id", "left")
            .withColumns({"likes": F.greatest(F.lit(0), F.coalesce("l", F.lit(0))).cast("long"),
                          "comments": F.greatest(F.lit(0), F.coalesce("c", F.lit(0))).cast("long")})
            .drop("l", "c"))


def feed(counted_posts: DataFrame, order: str, limit: int) -> DataFrame:
    """latest by time, trending by likes and twice the comments; TakeOrdered."""
    heat = F.col("likes") + 2 * F.col("comments")
    keys = [F.desc("heat")] if order == "trending" else [F.desc("created_at")]
    return counted_posts.withColumn("heat", heat).orderBy(*keys, F.asc("post_id")).limit(limit)


def drop_posts(comments: DataFrame, removed: DataFrame) -> DataFrame:
    return comments.join(removed.select("post_id"), "post_id", "left_anti")


def friends(friend_events: DataFrame) -> DataFrame:
    """Latest status per pair, of equal times the last in order; removed pairs are gone."""
    last = friend_events.groupBy("user_id", "friend_id").agg(F.max(F.struct("ts", "status"))["status"].alias("status"))
    return last.where(F.col("status") != "removed")


def exp_ledger(days: DataFrame, posts: DataFrame) -> DataFrame:
    """Both sources are reduced per user before they meet."""
    a = days.groupBy("user_id").agg((F.count("*") * fixed.EXP_PER_CHECKIN).alias("exp"))
    b = posts.groupBy("user_id").agg((F.count("*") * fixed.EXP_PER_POST).alias("exp"))
    return a.unionByName(b).groupBy("user_id").agg(F.sum("exp").alias("exp"))


def level_needs(levels: int) -> list[int]:
    return [math.floor(fixed.EXP_FIRST_LEVEL * fixed.EXP_GROWTH ** i) for i in range(levels)]


def level_from_exp(ledger: DataFrame) -> DataFrame:
    """Level, experience inside the level and the need of the next one.

    205 cumulative thresholds reach past the largest long, so the literal
    array is complete and the lookup needs no join.
    """
    needs = [n for n in level_needs(205)]
    starts = [0]
    for n in needs:
        if starts[-1] + n >= 2 ** 63:
            break
        starts.append(starts[-1] + n)
    lo = F.array(*[F.lit(s).cast("long") for s in starts])
    need = F.array(*[F.lit(n).cast("long") for n in needs[:len(starts)]])
    level = F.size(F.filter(lo, lambda s: s <= F.col("exp")))
    return ledger.withColumn("level", level).select(
        "user_id", "exp", F.col("level").cast("long"),
        (F.col("exp") - F.element_at(lo, level)).alias("exp_in_level"),
        F.element_at(need, level).alias("exp_to_next"))


def badge_metrics(habits: DataFrame, days: DataFrame, posts: DataFrame, like_events: DataFrame,
                  friend_events: DataFrame, as_of: str) -> DataFrame:
    """(user_id, type, value): one aggregation per condition type."""
    def metric(df: DataFrame, kind: str, value: Column) -> DataFrame:
        return df.groupBy("user_id").agg(value.cast("double").alias("value")).withColumn(
            "type", F.lit(kind))
    used = (days.select("habit_id", "user_id").distinct()
            .join(habits.select("habit_id", "category"), "habit_id"))
    liked = likes(like_events).groupBy("post_id").agg(F.count("*").alias("n")).join(
        posts.select("post_id", "user_id"), "post_id")
    accepted = friends(friend_events).where(F.col("status") == "accepted")
    return reduce(DataFrame.unionByName, [
        metric(hb.current_streaks(habits, days, as_of), "streak", F.max("streak")),
        metric(days, "total_checkins", F.count("*")),
        metric(habits, "habit_count", F.count("*")),
        metric(used, "category_master", F.countDistinct("category")),
        metric(posts, "posts", F.count("*")),
        metric(liked, "likes", F.sum("n")),
        metric(accepted, "friends", F.count("*")),
    ])


def badge_progress(users: DataFrame, metrics: DataFrame, held: DataFrame) -> DataFrame:
    """Percent per user and badge; 100 where the stored progress reached the
    target. Category badges count against all categories, not their target."""
    wanted = users.select("user_id").withColumn("b", F.explode(F.array(*[
        F.struct(F.lit(i).alias("badge_id"), F.lit(t).alias("type"), F.lit(n).alias("target"))
        for i, _, _, t, n in fixed.BADGES]))).select("user_id", "b.*")
    goal = F.when(F.col("type") == "category_master", F.lit(len(fixed.CATEGORIES))).otherwise(
        F.col("target"))
    computed = hb.half_up(F.least(F.lit(100.0), F.coalesce("value", F.lit(0.0)) / goal * 100))
    return (wanted.join(metrics, ["user_id", "type"], "left")
            .join(held.select("user_id", "badge_id", F.col("progress").alias("stored")),
                  ["user_id", "badge_id"], "left")
            .select("user_id", "badge_id", F.when(F.col("stored") >= F.col("target"),
                                                  F.lit(100).cast("long"))
                    .otherwise(computed).alias("progress")))


def badge_unlocks(progress: DataFrame, held: DataFrame) -> DataFrame:
    return progress.where(F.col("progress") >= 100).join(
        held.select("user_id", "badge_id"), ["user_id", "badge_id"], "left_anti")


def badge_summary(users: DataFrame, held: DataFrame) -> DataFrame:
    """Totals and unlocked per user by category, by rarity and overall."""
    has = held.select("user_id", "badge_id", F.lit(1).alias("has")).distinct()
    rows = users.select("user_id").withColumn("b", F.explode(F.array(*[
        F.struct(F.lit(i).alias("badge_id"), F.lit(c).alias("category"), F.lit(r).alias("rarity"))
        for i, c, r, _, _ in fixed.BADGES]))).select("user_id", "b.*").join(
        has, ["user_id", "badge_id"], "left")
    dims = rows.withColumn("d", F.explode(F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")),
        F.struct(F.lit("rarity").alias("kind"), F.col("rarity").alias("name")),
        F.struct(F.lit("overall").alias("kind"), F.lit("all").alias("name")))))
    out = dims.groupBy("user_id", "d.kind", "d.name").agg(
        F.count("*").alias("badges"), F.count("has").alias("unlocked"))
    return out.withColumn("percent", hb.half_up(F.col("unlocked") * 100.0 / F.col("badges")))


def circle_stats(counted_posts: DataFrame, comments: DataFrame, friend_events: DataFrame,
                 days: DataFrame, as_of: str) -> DataFrame:
    """(metric, value) rows; each is its own aggregate, so nothing is multiplied."""
    accepted = friends(friend_events).where(F.col("status") == "accepted")
    since = lambda n: F.col("date") >= F.date_sub(hb.day(as_of), n)

    def one(df: DataFrame, **aggs: Column) -> DataFrame:
        wide = df.agg(*[c.cast("long").alias(k) for k, c in aggs.items()])
        return wide.select(F.explode(F.create_map(*[
            x for k in aggs for x in (F.lit(k), F.col(k))])).alias("metric", "value"))
    parts = [
        one(counted_posts, total_posts=F.count("*"), total_likes=F.sum("likes"),
            active_users=F.countDistinct("user_id")),
        one(accepted, active_users=F.count("*")),
        one(comments, total_comments=F.count("*")),
        one(days, weekly_checkins=F.count_if(since(7)), monthly_checkins=F.count_if(since(30))),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("metric").agg(F.sum("value").alias("value"))
