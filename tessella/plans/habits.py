"""Habit, make-up, badge and circle queries over events and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.data import badges as fixed
from tessella.operators import habits as hb
from tessella.operators import social as so
from tessella.plans import contracts as c
from tessella.plans.contracts import AS_OF
from tessella.plans.registry import query
from tessella.plans.sqlparts import values
from tessella.session import ensure_checkpoint_dir

W = f"WITH {c.HABIT_CTES}"
D = f"DATE '{AS_OF}'"


def _days(spark, d):
    return hb.one_per_day(c.checkins(spark, d))


def _both(spark, d):
    return c.habits(spark, d), _days(spark, d)


def _s(name="date"):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


@query("checkins_dedup", f"{W} SELECT habit_id, date::VARCHAR AS date, checkin_id, type FROM days")
def checkins_dedup(spark, d):
    return _days(spark, d).select("habit_id", _s(), "checkin_id", "type")


@query("checkins_retract", f"""{W} SELECT habit_id, date::VARCHAR AS date FROM days
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.value < 5
  AND e.user_id || '-' || e.event_type = days.habit_id AND CAST(e.ts AS DATE) = days.date)""")
def checkins_retract(spark, d):
    from tessella.sources.tables import table
    gone = table(spark, d, "events").where("value < 5").select(
        F.concat_ws("-", "user_id", "event_type").alias("habit_id"), F.to_date("ts").alias("date"))
    return hb.retract(_days(spark, d), gone).select("habit_id", _s())


@query("habit_cascade_delete", f"""{W}, {c.SOCIAL_SQL},
gone AS (SELECT habit_id FROM habits WHERE user_id % 10 = 3),
hp AS (SELECT post_id, user_id || '-click' AS habit_id FROM posts)
SELECT 'checkin' AS kind, checkin_id AS id FROM days WHERE habit_id NOT IN (SELECT habit_id FROM gone)
UNION ALL SELECT 'post', post_id FROM hp WHERE habit_id NOT IN (SELECT habit_id FROM gone)""")
def habit_cascade_delete(spark, d):
    habits, days = _both(spark, d)
    gone = habits.where("user_id % 10 = 3")
    posts = c.posts(spark, d).withColumn("habit_id", F.concat("user_id", F.lit("-click")))
    kept = hb.without_habits(days, gone).select(F.lit("checkin").alias("kind"), F.col("checkin_id").alias("id"))
    return kept.unionByName(hb.without_habits(posts, gone).select(
        F.lit("post").alias("kind"), F.col("post_id").alias("id")))


STREAKS = f"""isl AS (SELECT habit_id, date, date - CAST(row_number() OVER (PARTITION BY habit_id ORDER BY date) AS INTEGER) AS g FROM days),
runs AS (SELECT habit_id, g, max(date) AS last_day, count(*) AS run FROM isl GROUP BY ALL),
lastrun AS (SELECT habit_id, max(last_day) AS last_day, arg_max(run, last_day) AS run FROM runs GROUP BY ALL),
streaks AS (SELECT habit_id, user_id, CASE WHEN last_day BETWEEN {D} - 1 AND {D} THEN run ELSE 0 END AS streak
  FROM habits LEFT JOIN lastrun USING (habit_id))"""


@query("current_streak", f"{W}, {STREAKS} SELECT * FROM streaks")
def current_streak(spark, d):
    return hb.current_streaks(*_both(spark, d), AS_OF)


@query("longest_current_streak", f"{W}, {STREAKS} SELECT user_id, max(streak) AS streak FROM streaks GROUP BY ALL")
def longest_current_streak(spark, d):
    return hb.current_streaks(*_both(spark, d), AS_OF).groupBy("user_id").agg(
        F.max("streak").alias("streak"))


@query("total_checkins", f"{W} SELECT habit_id, count(*) AS checkins FROM days GROUP BY ALL")
def total_checkins(spark, d):
    return hb.total_checkins(_days(spark, d))


@query("checkins_in_range", f"""{W} SELECT habit_id, date::VARCHAR AS date, checkin_id FROM days
WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""")
def checkins_in_range(spark, d):
    return hb.in_range(_days(spark, d), "2024-01-10", "2024-01-12").select("habit_id", _s(), "checkin_id")


def rate_sql(done: str, total: str) -> str:
    return f"""CASE WHEN {total} <= 0 THEN 0 ELSE least(100, {done}::DOUBLE / CASE frequency_type
  WHEN 'daily' THEN {total}::DOUBLE
  WHEN 'weekly' THEN greatest(1, ceil({total} / 7.0) * frequency_count)
  ELSE greatest(1, ceil({total} / 30.0) * frequency_count) END * 100) END"""


@query("completion_rate", f"""{W},
dn AS (SELECT habit_id, count(*) AS done FROM days WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY ALL)
SELECT habit_id, round({rate_sql('coalesce(done, 0)', '21')}, 6) AS rate FROM habits LEFT JOIN dn USING (habit_id)""")
def completion_rate(spark, d):
    return hb.completion_rate(*_both(spark, d), "2024-01-05", "2024-01-25").withColumn(
        "rate", F.round("rate", 6))


@query("completion_by_period", f"""{W},
p AS (SELECT * FROM (VALUES ('week', 7), ('month', 30), ('year', 365)) v(period, n)),
dn AS (SELECT habit_id, period, count(*) AS done FROM days, p WHERE date BETWEEN {D} - (n - 1) AND {D} GROUP BY ALL),
r AS (SELECT habit_id, period, floor({rate_sql('coalesce(done, 0)', 'n')} * 10 + 0.5) / 10 AS rate
  FROM (SELECT * FROM habits, p) LEFT JOIN dn USING (habit_id, period))
SELECT *, CASE WHEN rate >= 80 THEN 'high' WHEN rate >= 50 THEN 'middle' ELSE 'low' END AS band FROM r""")
def completion_by_period(spark, d):
    return hb.completion_by_period(*_both(spark, d), AS_OF)


@query("habit_ranking", f"""{W},
dn AS (SELECT days.habit_id, count(*) AS done FROM days JOIN habits h ON h.habit_id = days.habit_id
  WHERE date <= {D} AND date >= created_on GROUP BY ALL),
r AS (SELECT habit_id, floor({rate_sql('coalesce(done, 0)', f'({D} - created_on + 1)')} * 10 + 0.5) / 10 AS rate
  FROM habits LEFT JOIN dn USING (habit_id))
(SELECT *, 'top' AS side FROM r ORDER BY rate DESC, habit_id LIMIT 5) UNION ALL
(SELECT *, 'bottom' AS side FROM r ORDER BY rate, habit_id LIMIT 5)""")
def habit_ranking(spark, d):
    return hb.habit_ranking(*_both(spark, d), AS_OF)


CAL = "SELECT habit_id, unnest(range({n})) AS i FROM habits"


def cal(n):
    return f"(SELECT habit_id, {D} - CAST(i AS INTEGER) AS date FROM ({CAL.format(n=n)}))"


@query("trend_matrix", f"""{W} SELECT habit_id, date::VARCHAR AS date, (type IS NOT NULL)::INTEGER AS done
FROM {cal(30)} LEFT JOIN days USING (habit_id, date)""")
def trend_matrix(spark, d):
    return hb.trend_matrix(*_both(spark, d), AS_OF, 30).select("habit_id", _s(), "done")


@query("trend_matrix_year", f"""{W} SELECT habit_id, date::VARCHAR AS date, (type IS NOT NULL)::INTEGER AS done
FROM {cal(365)} LEFT JOIN days USING (habit_id, date)""")
def trend_matrix_year(spark, d):
    return hb.trend_matrix(*_both(spark, d), AS_OF, 365).select("habit_id", _s(), "done")


@query("last7_status", f"""{W} SELECT habit_id, date::VARCHAR AS date, (type IS NOT NULL)::INTEGER AS done,
coalesce(type = 'makeup', FALSE) AS is_makeup FROM {cal(7)} LEFT JOIN days USING (habit_id, date)""")
def last7_status(spark, d):
    return hb.trend_matrix(*_both(spark, d), AS_OF, 7).select("habit_id", _s(), "done", "is_makeup")


HEAT = """cal AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS date),
heat AS (SELECT date, coalesce(n, 0) AS checkins, least(coalesce(n, 0), 5) AS level FROM cal
  LEFT JOIN (SELECT date, count(*) AS n FROM days GROUP BY ALL) USING (date))"""


@query("heatmap_year", f"{W}, {HEAT} SELECT date::VARCHAR AS date, checkins, level FROM heat")
def heatmap_year(spark, d):
    return hb.heatmap_year(_days(spark, d), 2024).select(_s(), "checkins", "level")


@query("heatmap_grid", f"""{W}, {HEAT} SELECT date::VARCHAR AS date, checkins,
(dayofyear(date) - 1 + isodow(DATE '2024-01-01') - 1) // 7 AS week, isodow(date) - 1 AS weekday FROM heat""")
def heatmap_grid(spark, d):
    return hb.heatmap_grid(hb.heatmap_year(_days(spark, d), 2024), 2024).select(
        _s(), "checkins", "week", "weekday")


@query("day_detail", f"""{W} SELECT days.habit_id, name FROM days JOIN habits h ON h.habit_id = days.habit_id
WHERE date = DATE '2024-01-15'""")
def day_detail(spark, d):
    return hb.day_detail(*_both(spark, d), "2024-01-15")


@query("category_share", f"""{W}, p AS (SELECT category, count(*) AS checkins FROM days JOIN habits h
  ON h.habit_id = days.habit_id GROUP BY ALL)
SELECT category, checkins, floor(checkins * 100.0::DOUBLE / (SELECT sum(checkins) FROM p) + 0.5)::BIGINT AS percent FROM p""")
def category_share(spark, d):
    return hb.category_share(*_both(spark, d))


@query("today_completion", f"""{W} SELECT count(x.habit_id) AS done, count(*) AS habits,
floor(count(x.habit_id) * 100.0::DOUBLE / count(*) + 0.5)::BIGINT AS percent FROM habits h
LEFT JOIN (SELECT habit_id FROM days WHERE date = {D}) x ON x.habit_id = h.habit_id""")
def today_completion(spark, d):
    return hb.today_completion(*_both(spark, d), AS_OF)


@query("recent_checkins", f"""{W} SELECT habit_id, date::VARCHAR AS date, rank FROM (SELECT *, row_number()
OVER (PARTITION BY habit_id ORDER BY date DESC) AS rank FROM days) WHERE rank <= 14""")
def recent_checkins(spark, d):
    return hb.recent_checkins(_days(spark, d)).select("habit_id", _s(), F.col("rank").cast("long"))


@query("makeup_window", f"{W} SELECT checkin_id, {D} - date BETWEEN 0 AND 6 AS allowed FROM checkins")
def makeup_window(spark, d):
    return c.checkins(spark, d).select("checkin_id", hb.in_makeup_window(F.col("date"), AS_OF).alias("allowed"))


USED = """used AS (SELECT user_id, strftime(date, '%Y-%m') AS month, count(*) AS makeups FROM days
  WHERE type = 'makeup' GROUP BY ALL)"""


@query("makeup_month_count", f"{W}, {USED} SELECT * FROM used")
def makeup_month_count(spark, d):
    return hb.makeup_per_month(_days(spark, d))


@query("makeup_decision", f"""{W}, {USED},
req AS (SELECT habit_id, user_id, {D} - CAST(user_id % 9 - 1 AS INTEGER) AS date FROM habits),
r AS (SELECT q.habit_id, q.user_id, q.date, CASE WHEN NOT ({D} - q.date BETWEEN 0 AND 6) THEN 'outside window'
  WHEN x.habit_id IS NOT NULL THEN 'already done' WHEN coalesce(makeups, 0) >= 3 THEN 'quota used' ELSE 'ok' END AS reason
  FROM req q LEFT JOIN days x ON x.habit_id = q.habit_id AND x.date = q.date
  LEFT JOIN used ON used.user_id = q.user_id AND month = '2024-01')
SELECT habit_id, user_id, date::VARCHAR AS date, reason = 'ok' AS allowed, reason FROM r""")
def makeup_decision(spark, d):
    habits, days = _both(spark, d)
    req = habits.select("habit_id", "user_id", F.date_sub(
        hb.day(AS_OF), (F.col("user_id") % 9 - 1).cast("int")).alias("date"))
    return hb.makeup_decision(req, days, AS_OF).select("habit_id", "user_id", _s(), "allowed", "reason")


@query("makeup_dates_open", f"""{W} SELECT habit_id, date::VARCHAR AS date FROM {cal(7)}
ANTI JOIN days USING (habit_id, date)""")
def makeup_dates_open(spark, d):
    return hb.makeup_dates_open(*_both(spark, d), AS_OF).select("habit_id", _s())


@query("checkin_quality", f"""{W},
q AS (SELECT event_id AS checkin_id, CAST(ts AS DATE) AS date, value, event_id,
  printf('%d:%02d', user_id % 26, event_id % 75) AS t FROM events)
SELECT checkin_id, 'time_format' AS rule FROM q WHERE NOT regexp_matches(t, '{hb.CLOCK}')
UNION ALL SELECT checkin_id, 'date_in_future' FROM q WHERE date > DATE '2024-01-28'
UNION ALL SELECT checkin_id, 'remark_too_long' FROM q WHERE floor(value) > 200
UNION ALL SELECT checkin_id, 'location_too_long' FROM q WHERE event_id % 60 > 50""")
def checkin_quality(spark, d):
    from tessella.sources.tables import table
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("checkin_id"), F.to_date("ts").alias("date"),
        F.format_string("%d:%02d", F.col("user_id") % 26, F.col("event_id") % 75).alias("check_in_time"),
        F.repeat(F.lit("r"), F.floor("value").cast("int")).alias("remark"),
        F.repeat(F.lit("p"), (F.col("event_id") % 60).cast("int")).alias("location"))
    return hb.checkin_quality(rows, "2024-01-28")


@query("habit_quality", f"""{W},
q AS (SELECT habit_id, CASE WHEN user_id % 10 = 0 THEN '  ' ELSE name END AS name,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE category END AS category, user_id % 4 AS n FROM habits)
SELECT habit_id, 'name_missing' AS rule FROM q WHERE trim(name) = ''
UNION ALL SELECT habit_id, 'category_missing' FROM q WHERE category IS NULL
UNION ALL SELECT habit_id, 'count_too_small' FROM q WHERE n < 1""")
def habit_quality(spark, d):
    rows = c.habits(spark, d).select(
        "habit_id", F.when(F.col("user_id") % 10 == 0, "  ").otherwise(F.col("name")).alias("name"),
        F.when(F.col("user_id") % 7 != 0, F.col("category")).alias("category"),
        (F.col("user_id") % 4).alias("frequency_count"))
    return hb.habit_quality(rows)


HELD_SQL = f"""users AS (SELECT DISTINCT user_id FROM events),
badges AS {values(fixed.BADGES, 'badge_id, category, rarity, type, target')},
held AS (SELECT user_id, badge_id, 100 AS progress FROM users, badges
  WHERE user_id % 3 = 0 AND badge_id IN ('total-10', 'streak-365'))"""


def _users(spark, d):
    from tessella.sources.tables import table
    return table(spark, d, "events").select("user_id").distinct()


def _held(spark, d):
    return _users(spark, d).where("user_id % 3 = 0").select(
        "user_id", F.explode(F.array(F.lit("total-10"), F.lit("streak-365"))).alias("badge_id"),
        F.lit(100).alias("progress"))


LIKES = """likes AS (SELECT post_id, user_id FROM (SELECT post_id, user_id, arg_max(liked, ts) AS liked
  FROM like_events GROUP BY ALL) WHERE liked),
friends AS (SELECT * FROM (SELECT user_id, friend_id, arg_max(status, ts) AS status FROM friend_events
  GROUP BY ALL) WHERE status <> 'removed')"""
PROGRESS = f"""{c.HABIT_CTES}, {STREAKS}, {c.SOCIAL_SQL}, {LIKES}, {HELD_SQL},
m AS (SELECT user_id, 'streak' AS type, max(streak) AS v FROM streaks GROUP BY ALL
  UNION ALL SELECT user_id, 'total_checkins', count(*) FROM days GROUP BY ALL
  UNION ALL SELECT user_id, 'habit_count', count(*) FROM habits GROUP BY ALL
  UNION ALL SELECT h.user_id, 'category_master', count(DISTINCT category) FROM days JOIN habits h ON h.habit_id = days.habit_id GROUP BY ALL
  UNION ALL SELECT user_id, 'posts', count(*) FROM posts GROUP BY ALL
  UNION ALL SELECT posts.user_id, 'likes', count(*) FROM likes JOIN posts USING (post_id) GROUP BY ALL
  UNION ALL SELECT user_id, 'friends', count(*) FROM friends WHERE status = 'accepted' GROUP BY ALL),
progress AS (SELECT u.user_id, b.badge_id, CASE WHEN held.progress >= b.target THEN 100 ELSE
  floor(least(100.0, coalesce(v, 0)::DOUBLE / CASE b.type WHEN 'category_master' THEN {len(fixed.CATEGORIES)} ELSE b.target END * 100) + 0.5)::BIGINT END AS progress
  FROM users u CROSS JOIN badges b LEFT JOIN m ON m.user_id = u.user_id AND m.type = b.type
  LEFT JOIN held ON held.user_id = u.user_id AND held.badge_id = b.badge_id)"""


def _progress(spark, d):
    habits, days = _both(spark, d)
    metrics = so.badge_metrics(habits, days, c.posts(spark, d), c.like_events(spark, d),
                               c.friend_events(spark, d), AS_OF)
    return so.badge_progress(_users(spark, d), metrics, _held(spark, d))


@query("badge_progress", f"WITH {PROGRESS} SELECT * FROM progress")
def badge_progress(spark, d):
    return _progress(spark, d)


@query("badge_unlocks", f"""WITH {PROGRESS} SELECT p.* FROM progress p
ANTI JOIN held USING (user_id, badge_id) WHERE p.progress >= 100""")
def badge_unlocks(spark, d):
    return so.badge_unlocks(_progress(spark, d), _held(spark, d))


@query("badge_summary", f"""WITH {HELD_SQL},
r AS (SELECT u.user_id, b.*, held.badge_id IS NOT NULL AS has FROM users u CROSS JOIN badges b
  LEFT JOIN held ON held.user_id = u.user_id AND held.badge_id = b.badge_id),
s AS (SELECT user_id, 'category' AS kind, category AS name, count(*) AS badges, count(*) FILTER (has) AS unlocked FROM r GROUP BY ALL
 UNION ALL SELECT user_id, 'rarity', rarity, count(*), count(*) FILTER (has) FROM r GROUP BY ALL
 UNION ALL SELECT user_id, 'overall', 'all', count(*), count(*) FILTER (has) FROM r GROUP BY ALL)
SELECT *, floor(unlocked * 100.0::DOUBLE / badges + 0.5)::BIGINT AS percent FROM s""")
def badge_summary(spark, d):
    return so.badge_summary(_users(spark, d), _held(spark, d))


LEDGER = f"""{c.HABIT_CTES}, {c.SOCIAL_SQL},
ledger AS (SELECT user_id, sum(exp)::BIGINT AS exp FROM (SELECT user_id, 10 AS exp FROM days
  UNION ALL SELECT user_id, 5 FROM posts) GROUP BY ALL)"""


@query("exp_ledger", f"WITH {LEDGER} SELECT * FROM ledger")
def exp_ledger(spark, d):
    return so.exp_ledger(_days(spark, d), c.posts(spark, d))


@query("level_from_exp", f"""WITH {LEDGER},
need AS (SELECT i + 1 AS level, floor(100 * pow(1.2, i))::BIGINT AS need FROM range(80) t(i)),
lv AS (SELECT level, need, (sum(need) OVER (ORDER BY level) - need)::BIGINT AS lo FROM need)
SELECT user_id, exp, level, exp - lo AS exp_in_level, need AS exp_to_next
FROM ledger JOIN lv ON exp >= lo AND exp < lo + need""")
def level_from_exp(spark, d):
    return so.level_from_exp(so.exp_ledger(_days(spark, d), c.posts(spark, d)))


COUNTED = f"""{c.SOCIAL_SQL}, {LIKES},
counted AS (SELECT p.post_id, p.user_id, p.created_at,
  (SELECT count(*) FROM likes l WHERE l.post_id = p.post_id) AS likes,
  (SELECT count(*) FROM comments k WHERE k.post_id = p.post_id) AS comments FROM posts p)"""


def _counted(spark, d):
    return so.post_counters(c.posts(spark, d), c.like_events(spark, d), c.comments(spark, d))


@query("post_counters", f"WITH {COUNTED} SELECT post_id, likes, comments FROM counted")
def post_counters(spark, d):
    return _counted(spark, d).select("post_id", "likes", "comments")


@query("feed_ranked", f"""WITH {COUNTED},
h AS (SELECT *, likes + 2 * comments AS heat FROM counted)
(SELECT 'trending' AS tab, post_id, heat FROM h ORDER BY heat DESC, post_id LIMIT 20) UNION ALL
(SELECT 'latest', post_id, heat FROM h ORDER BY created_at DESC, post_id LIMIT 20)""")
def feed_ranked(spark, d):
    counted = _counted(spark, d)
    tabs = [so.feed(counted, t, 20).select(F.lit(t).alias("tab"), "post_id", "heat")
            for t in ("trending", "latest")]
    return tabs[0].unionByName(tabs[1])


@query("friend_status", f"WITH {c.SOCIAL_SQL}, {LIKES} SELECT * FROM friends")
def friend_status(spark, d):
    return so.friends(c.friend_events(spark, d))


@query("circle_stats", f"""WITH {c.CHECKINS_SQL}, {COUNTED}
SELECT 'total_posts' AS metric, count(*) AS value FROM posts
UNION ALL SELECT 'total_likes', sum(likes)::BIGINT FROM counted
UNION ALL SELECT 'total_comments', count(*) FROM comments
UNION ALL SELECT 'active_users', (SELECT count(DISTINCT user_id) FROM posts) + (SELECT count(*) FROM friends WHERE status = 'accepted')
UNION ALL SELECT 'weekly_checkins', count(*) FROM days WHERE date >= {D} - 7
UNION ALL SELECT 'monthly_checkins', count(*) FROM days WHERE date >= {D} - 30""")
def circle_stats(spark, d):
    return so.circle_stats(_counted(spark, d), c.comments(spark, d), c.friend_events(spark, d),
                           _days(spark, d), AS_OF)


@query("post_cascade_delete", f"""WITH {c.SOCIAL_SQL} SELECT comment_id, post_id FROM comments
WHERE post_id NOT IN (SELECT post_id FROM posts WHERE user_id % 4 = 1)""")
def post_cascade_delete(spark, d):
    return so.drop_posts(c.comments(spark, d), c.posts(spark, d).where("user_id % 4 = 1")).select(
        "comment_id", "post_id")


@query("reminders_due", f"""{W},
r AS (SELECT habit_id, TIMESTAMP '2024-01-30' + to_hours(CAST(user_id % 24 AS INTEGER)) + to_minutes(CAST(user_id % 60 AS INTEGER)) AS first,
  CASE user_id % 4 WHEN 0 THEN [] WHEN 1 THEN [1, 3, 5] WHEN 2 THEN [0, 6] ELSE [2] END AS allowed
  FROM habits WHERE user_id % 5 <> 0),
x AS (SELECT habit_id, allowed, first + to_days(CAST(i AS INTEGER)) AS due FROM r, range(8) t(i))
SELECT habit_id, strftime(min(due), '%Y-%m-%d %H:%M') AS due_at FROM x WHERE due > TIMESTAMP '2024-01-30 12:00:00'
  AND (len(allowed) = 0 OR list_contains(allowed, dayofweek(due))) GROUP BY ALL""")
def reminders_due(spark, d):
    rows = c.habits(spark, d).select(
        "habit_id", F.format_string("%02d:%02d", F.col("user_id") % 24, F.col("user_id") % 60)
        .alias("reminder_time"),
        F.expr("CASE user_id % 4 WHEN 0 THEN cast(array() as array<int>) WHEN 1 THEN array(1, 3, 5) "
               "WHEN 2 THEN array(0, 6) ELSE array(2) END").alias("reminder_days"),
        (F.col("user_id") % 5 != 0).alias("reminder_enabled"))
    return hb.reminders_due(rows, "2024-01-30 12:00:00").select(
        "habit_id", F.date_format("due_at", "yyyy-MM-dd HH:mm").alias("due_at"))


@query("day_board", f"""{W}, {USED} SELECT h.habit_id, x.habit_id IS NOT NULL AS done,
coalesce(makeups, 0) AS makeups, TRUE AS can_make_up FROM habits h
LEFT JOIN days x ON x.habit_id = h.habit_id AND x.date = DATE '2024-01-26'
LEFT JOIN used ON used.user_id = h.user_id AND month = '2024-01'""")
def day_board(spark, d):
    return hb.day_board(*_both(spark, d), "2024-01-26", AS_OF)


# ------------------------------------------------------------------------- exports

def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/exports/{name}-{uuid.uuid4().hex}"


EXPORT = f"""{W}, sel AS (SELECT d.*, h.name, h.category FROM days d JOIN habits h ON h.habit_id = d.habit_id
  WHERE h.category IN ('health', 'social') AND d.date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14')"""


@query("checkin_export_csv", f"""{EXPORT} SELECT date::VARCHAR AS date, name, category,
strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM sel""")
def checkin_export_csv(spark, d):
    from tessella.sources import exports
    habits, days = _both(spark, d)
    path = _scratch(spark, "csv")
    exports.checkins_csv(habits.where(F.col("category").isin("health", "social")), days, path,
                         "2024-01-08", "2024-01-14")
    return spark.read.schema("date string, name string, category string, created_at string").csv(
        path, header=True)


@query("checkin_export_json", f"""{EXPORT}
SELECT 'checkin' AS record, habit_id, date::VARCHAR AS date, type FROM sel
UNION ALL SELECT 'habit', habit_id, NULL, NULL FROM habits WHERE category IN ('health', 'social')""")
def checkin_export_json(spark, d):
    from tessella.sources import exports
    habits, days = _both(spark, d)
    path = _scratch(spark, "json")
    exports.checkins_json(habits.where(F.col("category").isin("health", "social")), days, path,
                          "2024-01-08", "2024-01-14")
    return spark.read.schema("record string, habit_id string, date string, type string").json(path)
