"""Linked notes: links, tags, search, versions, shares and account checks."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.rows import unnest
from tessella.operators.habits import broken_rules
from tessella.operators.ordered import previous_in_key

LINK = r"\[\[([a-f0-9]{12})\]\]"  # fixed value


def extract_links(notes: DataFrame) -> DataFrame:
    """Distinct (src, dst) of existing notes, no self-links. Deduplicated inside
    the note before the shuffle; the semi join is on dst, so a hub note is
    skew on the streamed side, which AQE splits."""
    found = F.array_distinct(F.regexp_extract_all("content", F.lit(LINK), 1))
    pairs = unnest(notes, ["note_id"], found, "dst").withColumnRenamed("note_id", "src")
    known = notes.select(F.col("note_id").alias("dst"))
    return pairs.where("src <> dst").join(known, "dst", "left_semi").select("src", "dst")


def outgoing(links: DataFrame, notes: DataFrame) -> DataFrame:
    titles = notes.select(F.col("note_id").alias("dst"), "title")
    return links.join(titles, "dst").select("src", "dst", "title")


def incoming(links: DataFrame, notes: DataFrame) -> DataFrame:
    titles = notes.select(F.col("note_id").alias("src"), "title")
    return links.join(titles, "src").select("dst", "src", "title")


def note_bundle(notes: DataFrame, note_tags: DataFrame, links: DataFrame) -> DataFrame:
    """Everything shown with a note, one row per item: (note_id, part, item,
    title). Rows instead of arrays, so a hub's backlinks stay distributed."""
    parts = [
        notes.select("note_id", F.lit("note").alias("part"), F.col("note_id").alias("item"), "title"),
        note_tags.select("note_id", F.lit("tag").alias("part"), F.col("tag").alias("item"),
                         F.col("tag").alias("title")),
        outgoing(links, notes).select(F.col("src").alias("note_id"), F.lit("outgoing").alias("part"),
                                      F.col("dst").alias("item"), "title"),
        incoming(links, notes).select(F.col("dst").alias("note_id"), F.lit("incoming").alias("part"),
                                      F.col("src").alias("item"), "title"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def note_markdown(notes: DataFrame, note_tags: DataFrame, links: DataFrame) -> DataFrame:
    """Markdown as (note_id, section, sort_key, block): sort by these columns and
    write the blocks. Head and body are one block; every link is its own line."""
    tags = note_tags.groupBy("note_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    line = F.when(F.size("tags") > 0, F.concat(
        F.lit("**Tags**: "), F.array_join(F.transform("tags", lambda t: F.concat(
            F.lit("`"), t, F.lit("`"))), ", "), F.lit("\n"))).otherwise(F.lit(""))
    head = F.concat(F.lit("# "), "title", F.lit("\n\n**ID**: "), "note_id", F.lit("\n**Created**: "),
                    stamp("created_at"), F.lit("\n**Updated**: "), stamp("updated_at"), F.lit("\n"),
                    F.coalesce(line, F.lit("")), F.lit("\n---\n\n"), "content", F.lit("\n"))
    base = notes.join(tags, "note_id", "left").select(
        "note_id", F.lit(0).alias("section"), F.lit("").alias("sort_key"), head.alias("block"))

    def listed(df: DataFrame, me: str, other: str, section: int, heading: str) -> DataFrame:
        rows = df.select(F.col(me).alias("note_id"), F.lit(section).alias("section"),
                         F.concat_ws(" ", "title", other).alias("sort_key"),
                         F.concat(F.lit("- [["), F.col(other), F.lit("]] "), "title").alias("block"))
        top = df.select(F.col(me).alias("note_id")).distinct().select(
            "note_id", F.lit(section).alias("section"), F.lit("").alias("sort_key"),
            F.lit(f"---\n\n## {heading}\n").alias("block"))
        return top.unionByName(rows)
    return (base.unionByName(listed(outgoing(links, notes), "src", "dst", 1, "Outgoing Links"))
            .unionByName(listed(incoming(links, notes), "dst", "src", 2, "Incoming Links")))


def graph(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id, other): nodes with their title, edges with their target."""
    return notes.select(F.lit("node").alias("kind"), F.col("note_id").alias("id"),
                        F.col("title").alias("other")).unionByName(
        links.select(F.lit("edge").alias("kind"), F.col("src").alias("id"), F.col("dst").alias("other")))


def fold_ascii(c: Column) -> Column:
    """Case folding of A to Z only, as LIKE does in the notes database."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def note_search(notes: DataFrame, query: str) -> DataFrame:
    """Substring match on title or content, newest first; a blank query finds
    nothing. % and _ keep their LIKE meaning."""
    q = query.strip()
    if not q:
        return notes.limit(0)
    for upper, lower in zip(string.ascii_uppercase, string.ascii_lowercase):
        q = q.replace(upper, lower)
    pattern = "%" + q.replace("\\", "\\\\") + "%"
    hit = fold_ascii(F.col("title")).like(pattern) | fold_ascii(F.col("content")).like(pattern)
    return notes.where(hit).orderBy(F.desc("updated_at"), F.asc("note_id"))


def highlight(text: Column, query: str, shown: int = 500) -> Column:
    """The result list shows the first 500 characters with the hits marked."""
    return F.regexp_replace(F.substring(text, 1, shown), f"(?iu)({re.escape(query)})",
                            "<mark>$1</mark>")


def tag_counts(tags: DataFrame, note_tags: DataFrame) -> DataFrame:
    n = note_tags.groupBy("tag").agg(F.count("*").alias("n"))
    return tags.join(n, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("notes"))


def notes_by_tag(notes: DataFrame, note_tags: DataFrame, tag: str) -> DataFrame:
    ids = note_tags.where(F.col("tag") == tag).select("note_id")
    return notes.join(ids, "note_id", "left_semi").orderBy(F.desc("updated_at"), F.asc("note_id"))


# ------------------------------------------------------------------------ shares

def share_valid(as_of: str) -> Column:
    """Active and not past its expiry; an unreadable expiry does not expire."""
    expires = F.try_to_timestamp(F.col("expires_at"))
    return F.col("is_active") & ~F.coalesce(F.lit(as_of).cast("timestamp") > expires, F.lit(False))


def share_listing(shares: DataFrame, notes: DataFrame, as_of: str) -> DataFrame:
    titles = notes.select("note_id", "title")
    return shares.where("is_active").join(titles, "note_id", "left").select(
        "token", "note_id", "title", "permission", "created_at", share_valid(as_of).alias("valid"))


def access_decision(attempts: DataFrame, shares: DataFrame, notes: DataFrame, as_of: str) -> DataFrame:
    """(attempt_id, token, password, wants_write) → status and reason. Attempts
    are grouped by distinct request first, so a hot token is looked up once."""
    s = shares.select("token", "note_id", "permission", "is_active", "expires_at", "password_hash",
                      F.lit(True).alias("known"))
    n = notes.select("note_id", F.lit(True).alias("there"))
    asked = attempts.select("token").distinct().join(s, "token", "left").join(n, "note_id", "left")
    rows = attempts.join(asked, "token")
    expired = ~share_valid(as_of)
    pw = F.col("password_hash").isNotNull()
    blank = F.coalesce(F.col("password"), F.lit("")) == ""
    def outcome(code: int, reason: str) -> Column:
        return F.struct(F.lit(code).alias("status"), F.lit(reason).alias("reason"))
    wrong = F.sha2("password", 256) != F.col("password_hash")
    status = (F.when(F.col("known").isNull(), outcome(404, "no share"))
              .when(~F.col("is_active"), outcome(403, "revoked"))
              .when(expired, outcome(403, "expired"))
              .when(pw & blank, outcome(401, "password required"))
              .when(pw & wrong, outcome(403, "wrong password"))
              .when(F.col("there").isNull(), outcome(404, "note gone"))
              .when(F.col("wants_write") & (F.col("permission") != "write"), outcome(403, "read only"))
              .otherwise(outcome(200, "ok")))
    return rows.withColumn("d", status).select("attempt_id", "d.status", "d.reason")


# ---------------------------------------------------------------------- versions

VERSION_BLOCK = 1000


def _block() -> Column:
    return F.floor(F.col("version") / VERSION_BLOCK)


def version_page(versions: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first per note with the note's total. The rank is limited before
    the shuffle, the total is a separate partial aggregation."""
    w = Window.partitionBy("note_id").orderBy(F.desc("version"))
    page = versions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= offset + limit)
    total = versions.groupBy("note_id").agg(F.count("*").alias("total"))
    return page.where(F.col("rank") > offset).join(total, "note_id")


# The texts of a change summary.
EMPTY_TITLE, NO_CHANGE, CONTENT_CHANGED = "(空标题)", "未检测到修改", "内容修改"
TITLE_CHANGE, CONTENT_GREW, CONTENT_SHRANK = '标题: "%s" → "%s"', "内容增加 %d 字符", "内容减少 %d 字符"


def change_summary(versions: DataFrame) -> DataFrame:
    rows = previous_in_key(versions, ["note_id"], _block(), ["version"], ["title", "content"])
    shown = lambda c: F.when(F.coalesce(c, F.lit("")) == "", EMPTY_TITLE).otherwise(c)
    grew = (F.length(F.coalesce("content", F.lit("")))
            - F.length(F.coalesce("prev.content", F.lit(""))))
    title = F.when(~F.col("title").eqNullSafe(F.col("prev.title")), F.format_string(
        TITLE_CHANGE, shown(F.col("prev.title")), shown(F.col("title"))))
    body = F.when(~F.col("content").eqNullSafe(F.col("prev.content")),
                  F.when(grew > 0, F.format_string(CONTENT_GREW, grew))
                  .when(grew < 0, F.format_string(CONTENT_SHRANK, -grew)).otherwise(CONTENT_CHANGED))
    text = F.concat_ws("; ", title, body)
    return rows.where(F.col("prev").isNotNull()).select(
        "note_id", "version", F.when(text == "", NO_CHANGE).otherwise(text).alias("summary"))


def drop_noop_versions(versions: DataFrame) -> DataFrame:
    rows = previous_in_key(versions, ["note_id"], _block(), ["version"], ["title", "content"])
    same = (F.col("prev").isNotNull() & F.col("title").eqNullSafe(F.col("prev.title"))
            & F.col("content").eqNullSafe(F.col("prev.content")))
    return rows.where(~same).drop("prev")


def restore_version(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows to append for (note_id, version_id) requests: the named version
    becomes the newest one. Versions of another note and restores that change
    nothing add no row."""
    latest = versions.groupBy("note_id").agg(F.max_by(
        F.struct("version", "title", "content"), "version").alias("now"))
    picked = versions.select("note_id", "version_id", F.col("version").alias("restored_from"),
                             "title", "content")
    rows = requests.join(picked, ["note_id", "version_id"]).join(latest, "note_id")
    changed = ~(F.col("title").eqNullSafe(F.col("now.title"))
                & F.col("content").eqNullSafe(F.col("now.content")))
    return rows.where(changed).select(
        "note_id", (F.col("now.version") + 1).alias("version"), "restored_from", "title", "content")


# ------------------------------------------------------------- deletion, accounts

def cascade_delete(deleted: DataFrame, notes: DataFrame, note_tags: DataFrame, links: DataFrame,
                   versions: DataFrame, shares: DataFrame) -> dict[str, DataFrame]:
    gone = deleted.select("note_id")
    keep = lambda df: df.join(gone, "note_id", "left_anti")
    ends = links
    for end in ("src", "dst"):
        ends = ends.join(gone.withColumnRenamed("note_id", end), end, "left_anti")
    return {"notes": keep(notes), "note_tags": keep(note_tags), "links": ends.select("src", "dst"),
            "versions": keep(versions), "shares": keep(shares)}


USERNAME = r"^[a-zA-Z0-9_\x{4e00}-\x{9fa5}]+$"  # fixed values
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"


def account_quality(accounts: DataFrame) -> DataFrame:
    """(account_id, rule) per broken rule. Of accounts sharing a name or an
    address the first keeps it; a hot value is reduced to one row beforehand."""
    def owner(col: str) -> DataFrame:
        return accounts.where(F.col(col) != "").groupBy(col).agg(
            F.min("account_id").alias(f"{col}_owner"))
    rows = accounts.join(owner("username"), "username", "left").join(owner("email"), "email", "left")
    name, mail = F.coalesce("username", F.lit("")), F.coalesce("email", F.lit(""))
    return broken_rules(rows, "account_id", {
        "username_too_short": F.length(F.trim(name)) < 3,
        "username_too_long": F.length(name) > 20,
        "username_characters": ~name.rlike(USERNAME),
        "username_taken": F.col("account_id") != F.col("username_owner"),
        "email_missing": mail == "",
        "email_format": (mail != "") & ~mail.rlike(EMAIL),
        "email_taken": F.col("account_id") != F.col("email_owner"),
    })
