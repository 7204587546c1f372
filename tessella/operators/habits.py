"""Habit and check-in analytics.

A check-in table is first reduced to one row per (habit, date); after that a
habit has at most one row per calendar day, so windows partitioned by habit are
bounded by the calendar even when one habit owns a third of the raw rows.
`as_of` stands for today everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.data import badges as fixed
from tessella.functions.rows import unnest


def day(value: str) -> Column:
    return F.lit(value).cast("date")


def half_up(value: Column) -> Column:
    """Rounding to whole numbers as shown to users."""
    return F.floor(value + 0.5).cast("long")


def one_per_day(checkins: DataFrame) -> DataFrame:
    """First check-in of a (habit, date) wins, of equal times the smaller id;
    combines map-side."""
    first = F.min(F.struct("created_at", "checkin_id", "type")).alias("_f")
    return checkins.groupBy("habit_id", "user_id", "date").agg(first).select(
        "habit_id", "user_id", "date", "_f.checkin_id", "_f.type", "_f.created_at")


def retract(days: DataFrame, removed: DataFrame) -> DataFrame:
    return days.join(removed.select("habit_id", "date"), ["habit_id", "date"], "left_anti")


def without_habits(rows: DataFrame, removed: DataFrame) -> DataFrame:
    return rows.join(removed.select("habit_id"), "habit_id", "left_anti")


def current_streaks(habits: DataFrame, days: DataFrame, as_of: str) -> DataFrame:
    """Length of the run ending on as_of or the day before, else 0."""
    w = Window.partitionBy("habit_id").orderBy("date")
    island = F.date_sub("date", F.row_number().over(w))
    runs = (days.select("habit_id", "date").withColumn("island", island)
            .groupBy("habit_id", "island")
            .agg(F.max("date").alias("last_day"), F.count("*").alias("run")))
    last = runs.groupBy("habit_id").agg(
        F.max("last_day").alias("last_day"), F.max_by("run", "last_day").alias("run"))
    alive = F.col("last_day").between(F.date_sub(day(as_of), 1), day(as_of))
    return habits.join(last, "habit_id", "left").select(
        "habit_id", "user_id", F.when(alive, F.col("run")).otherwise(F.lit(0)).alias("streak"))


def total_checkins(days: DataFrame) -> DataFrame:
    return days.groupBy("habit_id").agg(F.count("*").alias("checkins"))


def in_range(days: DataFrame, start: str, end: str) -> DataFrame:
    return days.where(F.col("date").between(day(start), day(end)))


def rate(done: Column, total_days: Column, frequency: Column, per: Column) -> Column:
    """Share of the days or repetitions a habit asks for, 0..100."""
    weeks, months = F.ceil(total_days / 7), F.ceil(total_days / 30)
    expected = (F.when(frequency == "daily", total_days.cast("double"))
                .when(frequency == "weekly", F.greatest(F.lit(1.0), (weeks * per).cast("double")))
                .otherwise(F.greatest(F.lit(1.0), (months * per).cast("double"))))
    return F.when(total_days <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(100.0), done / expected * 100))


def completion_rate(habits: DataFrame, days: DataFrame, start: str, end: str) -> DataFrame:
    done = in_range(days, start, end).groupBy("habit_id").agg(F.count("*").alias("done"))
    total = F.datediff(day(end), day(start)) + 1
    return habits.join(done, "habit_id", "left").select(
        "habit_id", rate(F.coalesce("done", F.lit(0)), total, F.col("frequency_type"),
                         F.col("frequency_count")).alias("rate"))


PERIODS = {"week": 7, "month": 30, "year": 365}  # fixed values


def completion_by_period(habits: DataFrame, days: DataFrame, as_of: str) -> DataFrame:
    """All periods from one aggregation; the three rows are made afterwards."""
    def within(n):
        return F.count_if(F.col("date").between(F.date_sub(day(as_of), n - 1), day(as_of)))
    done = days.groupBy("habit_id").agg(*[within(n).alias(p) for p, n in PERIODS.items()])
    rows = habits.join(done, "habit_id", "left").withColumn("p", F.explode(F.array(*[
        F.struct(F.lit(p).alias("period"), F.lit(n).alias("n"),
                 F.coalesce(F.col(p), F.lit(0)).alias("done")) for p, n in PERIODS.items()])))
    raw = rate(F.col("p.done"), F.col("p.n"), F.col("frequency_type"), F.col("frequency_count"))
    shown = F.floor(raw * 10 + 0.5) / 10
    return rows.select("habit_id", "p.period", shown.alias("rate")).withColumn(
        "band", F.when(F.col("rate") >= 80, "high").when(F.col("rate") >= 50, "middle")
        .otherwise("low"))


def rates_since_creation(habits: DataFrame, days: DataFrame, as_of: str) -> DataFrame:
    h = habits.select("habit_id", "frequency_type", "frequency_count", "created_on")
    done = (days.where(F.col("date") <= day(as_of)).join(h.select("habit_id", "created_on"), "habit_id")
            .where(F.col("date") >= F.col("created_on"))
            .groupBy("habit_id").agg(F.count("*").alias("done")))
    total = F.datediff(day(as_of), F.col("created_on")) + 1
    raw = rate(F.coalesce("done", F.lit(0)), total, F.col("frequency_type"), F.col("frequency_count"))
    return h.join(done, "habit_id", "left").select(
        "habit_id", (F.floor(raw * 10 + 0.5) / 10).alias("rate"))


def habit_ranking(habits: DataFrame, days: DataFrame, as_of: str, k: int = 5) -> DataFrame:
    rates = rates_since_creation(habits, days, as_of)
    top = rates.orderBy(F.desc("rate"), F.asc("habit_id")).limit(k).withColumn("side", F.lit("top"))
    low = rates.orderBy(F.asc("rate"), F.asc("habit_id")).limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def with_calendar(rows: DataFrame, as_of: str, n_days: int) -> DataFrame:
    """One row per input row and day; the calendar is made in place, not joined."""
    return rows.withColumn("date", F.explode(F.sequence(
        F.date_sub(day(as_of), n_days - 1), day(as_of))))


def trend_matrix(habits: DataFrame, days: DataFrame, as_of: str, n_days: int) -> DataFrame:
    done = days.select("habit_id", "date", "type")
    return with_calendar(habits.select("habit_id"), as_of, n_days).join(
        done, ["habit_id", "date"], "left").select(
        "habit_id", "date", F.col("type").isNotNull().cast("int").alias("done"),
        (F.col("type").eqNullSafe("makeup")).alias("is_makeup"))


def heatmap_year(days: DataFrame, year: int) -> DataFrame:
    calendar = days.sparkSession.range(1).select(F.explode(F.sequence(
        day(f"{year}-01-01"), day(f"{year}-12-31"))).alias("date"))
    counts = days.groupBy("date").agg(F.count("*").alias("checkins"))
    return calendar.join(counts, "date", "left").select(
        "date", F.coalesce("checkins", F.lit(0)).alias("checkins")).withColumn(
        "level", F.least("checkins", F.lit(5)))


def heatmap_grid(heatmap: DataFrame, year: int) -> DataFrame:
    """Column = week, row = weekday with Monday first."""
    offset = F.weekday(day(f"{year}-01-01"))
    return heatmap.withColumns({
        "week": F.floor((F.dayofyear("date") - 1 + offset) / 7).cast("long"),
        "weekday": F.weekday("date").cast("long")})


def day_detail(habits: DataFrame, days: DataFrame, date: str) -> DataFrame:
    return days.where(F.col("date") == day(date)).join(
        habits.select("habit_id", "name"), "habit_id").select("habit_id", "name")


def category_share(habits: DataFrame, days: DataFrame) -> DataFrame:
    """Counts per habit are joined, not raw check-ins, so a hot habit is one row."""
    per = (total_checkins(days).join(habits.select("habit_id", "category"), "habit_id")
           .groupBy("category").agg(F.sum("checkins").alias("checkins")))
    total = per.agg(F.sum("checkins")).scalar()
    return per.withColumn("percent", half_up(F.col("checkins") * 100.0 / total))


def today_completion(habits: DataFrame, days: DataFrame, as_of: str) -> DataFrame:
    done = days.where(F.col("date") == day(as_of)).select("habit_id", F.lit(1).alias("done"))
    return (habits.join(done, "habit_id", "left")
            .agg(F.count("done").alias("done"), F.count("*").alias("habits"))
            .withColumn("percent", F.when(F.col("habits") > 0, half_up(
                F.col("done") * 100.0 / F.col("habits"))).otherwise(F.lit(0).cast("long"))))


def recent_checkins(days: DataFrame, k: int = 14) -> DataFrame:
    w = Window.partitionBy("habit_id").orderBy(F.desc("date"))
    return days.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def in_makeup_window(date: Column, as_of: str) -> Column:
    return F.datediff(day(as_of), date).between(0, fixed.MAKEUP_DAYS - 1)


def makeup_per_month(days: DataFrame) -> DataFrame:
    """Counted by the date made up for, over all habits of a user."""
    return days.where(F.col("type") == "makeup").groupBy(
        "user_id", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("makeups"))


def makeup_decision(requests: DataFrame, days: DataFrame, as_of: str) -> DataFrame:
    """(habit, user, date) requests; the quota is that of the current month."""
    used = makeup_per_month(days).where(F.col("month") == as_of[:7]).select("user_id", "makeups")
    done = days.select("habit_id", "date", F.lit(True).alias("done"))
    rows = requests.join(done, ["habit_id", "date"], "left").join(used, "user_id", "left")
    reason = (F.when(~in_makeup_window(F.col("date"), as_of), "outside window")
              .when(F.col("done"), "already done")
              .when(F.coalesce("makeups", F.lit(0)) >= fixed.MAKEUP_PER_MONTH, "quota used"))
    return rows.select("habit_id", "user_id", "date", reason.isNull().alias("allowed"),
                       F.coalesce(reason, F.lit("ok")).alias("reason"))


def makeup_dates_open(habits: DataFrame, days: DataFrame, as_of: str) -> DataFrame:
    return with_calendar(habits.select("habit_id"), as_of, fixed.MAKEUP_DAYS).join(
        days.select("habit_id", "date"), ["habit_id", "date"], "left_anti")


CLOCK = r"^([01]?\d|2[0-3]):[0-5]\d$"  # fixed value


def checkin_quality(rows: DataFrame, as_of: str) -> DataFrame:
    """One row per check-in and broken rule."""
    rules = {
        "time_format": F.coalesce(~F.col("check_in_time").rlike(CLOCK), F.lit(True)),
        "date_in_future": F.col("date") > day(as_of),
        "remark_too_long": F.length("remark") > fixed.REMARK_LENGTH,
        "location_too_long": F.length("location") > fixed.LOCATION_LENGTH,
    }
    return broken_rules(rows, "checkin_id", rules)


def broken_rules(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return unnest(rows, [key], broken, "rule")


def habit_quality(habits: DataFrame) -> DataFrame:
    return broken_rules(habits, "habit_id", {
        "name_missing": F.trim(F.coalesce("name", F.lit(""))) == "",
        "category_missing": F.coalesce("category", F.lit("")) == "",
        "count_too_small": F.col("frequency_count") < 1,
    })


def reminders_due(habits: DataFrame, now: str) -> DataFrame:
    """(habit_id, reminder_time HH:mm, reminder_days, reminder_enabled): the next
    allowed moment after now; an empty day list allows every day, Sunday is 0."""
    moment = F.lit(now).cast("timestamp")
    first = F.to_timestamp(F.concat_ws(" ", F.lit(now[:10]), "reminder_time"), "yyyy-MM-dd HH:mm")
    candidates = F.transform(F.sequence(F.lit(0), F.lit(7)),
                             lambda i: F.timestamp_add("DAY", i, first))
    due = F.filter(candidates, lambda t: (t > moment) & (
        (F.size("reminder_days") == 0)
        | F.array_contains(F.col("reminder_days"), (F.dayofweek(t) - 1).cast("int"))))
    return habits.where("reminder_enabled").select("habit_id", F.array_min(due).alias("due_at"))


def day_board(habits: DataFrame, days: DataFrame, date: str, as_of: str) -> DataFrame:
    """Per habit on one date: done, the user's make-ups this month, and whether
    the date can be made up for at all (never today)."""
    on_date = days.where(F.col("date") == day(date)).select("habit_id", F.lit(True).alias("d"))
    used = makeup_per_month(days).where(F.col("month") == as_of[:7]).select("user_id", "makeups")
    return habits.join(on_date, "habit_id", "left").join(used, "user_id", "left").select(
        "habit_id", F.coalesce("d", F.lit(False)).alias("done"),
        F.coalesce("makeups", F.lit(0)).alias("makeups"),
        (in_makeup_window(day(date), as_of) & F.lit(date != as_of)).alias("can_make_up"))
