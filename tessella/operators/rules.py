"""Rules held as data, matched against file inventories.

Rule tables are configuration: they are read once behind a size check and
become column predicates, so matching any number of files is one map-only
projection without a join. Constants such as '10MB' or '30d' are parsed by the
same expressions that parse columns and fold away at planning time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.data import filetypes as ft
from tessella.functions import files as fx
from tessella.functions.rows import unnest
from tessella.operators.ordered import running_sum_in_key, sequence_by_range, sequence_in_key

MAX_RULE_ROWS = 20_000


@dataclass
class Rule:
    id: int
    name: str
    priority: int = 0
    enabled: bool = True
    logic: str = "AND"
    conditions: list[dict] = field(default_factory=list)
    actions: list[dict] = field(default_factory=list)


def _configuration(df: DataFrame) -> list:
    rows = df.limit(MAX_RULE_ROWS + 1).collect()
    if len(rows) > MAX_RULE_ROWS:
        raise ValueError(f"rule tables are configuration; more than {MAX_RULE_ROWS} rows given")
    return rows


def load_rules(rules: DataFrame, conditions: DataFrame, actions: DataFrame | None = None) -> list[Rule]:
    """(id, name, priority, enabled, logic_operator), (rule_id, condition_type,
    condition_value, negate, sort_order), (rule_id, action_type, action_params,
    sort_order) → Rule objects."""
    book = {r["id"]: Rule(r["id"], r["name"], r["priority"], r["enabled"],
                          r["logic_operator"]) for r in _configuration(rules)}
    for c in sorted(_configuration(conditions), key=lambda r: r["sort_order"]):
        book[c["rule_id"]].conditions.append({"type": c["condition_type"], "value": c["condition_value"],
                                              "negate": c["negate"]})
    for a in sorted(_configuration(actions) if actions is not None else [], key=lambda r: r["sort_order"]):
        book[a["rule_id"]].actions.append({"type": a["action_type"], **(a["action_params"] or {})})
    return list(book.values())


def condition(kind: str, value: str, as_of: str) -> Column:
    """One condition as a predicate; anything unusable is false."""
    if not value:
        return F.lit(False)
    size, modified, created = F.col("size"), F.col("modified_time"), F.col("created_time")
    if kind == "extension":
        return F.col("extension").isin(*[e.strip().lower() for e in value.split(",")])
    if kind == "filename_keyword":
        hits = [F.lower("name").contains(k.strip().lower()) for k in value.split(",")]
        return F.greatest(*hits) if len(hits) > 1 else hits[0]
    if kind == "file_size_min":
        return size >= fx.parse_size(F.lit(value))
    if kind == "file_size_max":
        return size <= fx.parse_size(F.lit(value))
    if kind in ("date_modified_from", "date_created_from"):
        return (modified if "modified" in kind else created) >= fx.parse_when(F.lit(value), as_of)
    if kind in ("date_modified_to", "date_created_to"):
        return (modified if "modified" in kind else created) <= fx.parse_when(F.lit(value), as_of)
    if kind == "regex":
        try:
            re.compile(value)
        except re.error:
            return F.lit(False)
        return F.col("name").rlike(f"(?iu){value}")
    if kind == "file_type":
        group = ft.RULE_TYPES.get(value.strip().lower())
        exts = ft.RULE_CODE if group == "code" else ft.CATEGORIES.get(group, "")
        return F.col("extension").isin(*exts.split()) if exts else F.lit(False)
    return F.lit(False)


def predicate(rule: Rule, as_of: str) -> Column:
    if not rule.conditions:
        return F.lit(True)
    parts = []
    for c in rule.conditions:
        p = F.coalesce(condition(c["type"], c["value"], as_of), F.lit(False))
        parts.append(~p if c.get("negate") else p)
    every, some = parts[0], parts[0]
    for p in parts[1:]:
        every, some = every & p, some | p
    logic = rule.logic.upper()
    return some if logic == "OR" else ~every if logic == "NOT" else every


def ordered(rules: list[Rule]) -> list[Rule]:
    """Enabled rules, best first; names stay with their own rule."""
    return sorted((r for r in rules if r.enabled), key=lambda r: (-r.priority, r.id))


def match_all(files: DataFrame, rules: list[Rule], as_of: str) -> DataFrame:
    """(path, rule_id, priority) for every matching rule."""
    hits = F.array_compact(F.array(*[
        F.when(predicate(r, as_of), F.struct(F.lit(r.id).alias("rule_id"),
                                             F.lit(r.priority).alias("priority")))
        for r in ordered(rules)]))
    return unnest(files, ["path"], hits, "m").select("path", "m.*")


def match_first(files: DataFrame, rules: list[Rule], as_of: str) -> DataFrame:
    """Files with the id of their best rule."""
    best = F.coalesce(*[F.when(predicate(r, as_of), F.lit(r.id)) for r in ordered(rules)])
    return files.withColumn("rule_id", best).where("rule_id IS NOT NULL")


def rule_test(files: DataFrame, rule: Rule, as_of: str) -> DataFrame:
    return files.withColumn("matched", predicate(rule, as_of) if rule.enabled else F.lit(False))


# ----------------------------------------------------------------------- actions

def template_context() -> dict[str, Column]:
    def parts(prefix: str, c: str) -> dict[str, Column]:
        return {prefix: F.date_format(c, "yyyyMMdd"), f"{prefix}_year": F.date_format(c, "yyyy"),
                f"{prefix}_month": F.date_format(c, "MM"), f"{prefix}_day": F.date_format(c, "dd")}
    return {"filename": F.col("name"), "name": fx.stem(F.col("name")), "ext": F.col("extension"),
            "extension": F.col("extension"), "size": F.col("size").cast("string"),
            **parts("modified", "modified_time"), **parts("created", "created_time")}


def resolve(template: str, context: dict[str, Column]) -> Column:
    out = F.lit(template)
    for key, value in context.items():
        if "{" + key + "}" in template:
            out = F.replace(out, F.lit("{" + key + "}"), value)
    return out


def action_target(action: dict, current: Column, run_stamp: str) -> Column:
    """Where an action puts the file; relative folders start at the source's."""
    ctx = template_context()
    source_dir, here = F.col("parent"), fx.base_name(current)

    def folder(key: str, default: Column) -> Column:
        return fx.join_path(source_dir, resolve(action[key], ctx)) if action.get(key) else default
    kind = action["type"]
    name = resolve(action["new_name"], ctx) if action.get("new_name") else here
    if kind in ("move", "copy"):
        return fx.join_path(folder("target_dir", source_dir), name)
    if kind == "rename":
        return fx.join_path(fx.dir_name(current), name)
    if kind == "backup":
        default = F.concat(fx.dir_name(current), F.lit("/.fo_backup"))
        return fx.join_path(folder("backup_dir", default), F.concat(F.lit(run_stamp + "_"), here))
    if kind == "zip":
        zipped = (resolve(action["zip_name"], ctx) if action.get("zip_name")
                  else F.concat(fx.stem(here), F.lit(".zip")))
        return fx.join_path(folder("target_dir", fx.dir_name(current)), zipped)
    return F.lit(None).cast("string")


def action_plan(files: DataFrame, rules: list[Rule], as_of: str, run_stamp: str = "20240130_000000") -> DataFrame:
    """Dry run: every step of the best rule of each file. Moves and renames hand
    their target on as the next source, as nested expressions of one projection."""
    chains = None
    for r in ordered(rules):
        current, steps = F.col("path"), []
        for i, a in enumerate(r.actions, 1):
            target = action_target(a, current, run_stamp)
            known = a["type"] in ("move", "copy", "rename", "backup", "zip")
            steps.append(F.struct(
                F.lit(i).alias("step"), F.lit(a["type"]).alias("action"), current.alias("source"),
                target.alias("target"), F.lit("success" if known else "failed").alias("status")))
            if a["type"] in ("move", "rename"):
                current = target
        if steps:
            hit = F.col("rule_id") == r.id
            chain = F.array(*steps)
            chains = F.when(hit, chain) if chains is None else chains.when(hit, chain)
    planned = match_first(files, rules, as_of)
    if chains is None:
        chains = F.expr("cast(NULL AS array<struct<step:int,action:string,source:string,"
                        "target:string,status:string>>)")
    return unnest(planned, ["path", "rule_id"], chains, "s").select("path", "rule_id", "s.*")


COPY_NAME = r"^(.*)\((\d+)\)(\.[^./]*)?$"


def target_collisions(moves: DataFrame, existing: DataFrame, block: int = 1000) -> DataFrame:
    """(source, target) and existing (path) → final target name, name(1), name(2)…

    The r-th file aimed at a name gets the r-th number not taken yet: r plus the
    taken numbers t_j with t_j - j <= r. Both the rank and that count come from
    bucketed running sums, so a name wanted by very many files is no hot task.
    """
    targets = moves.select("target").distinct()
    p = F.col("path")
    taken = existing.select(p.alias("target"), F.lit(0).cast("long").alias("t")).unionByName(
        existing.where(p.rlike(COPY_NAME)).select(
            F.concat(F.regexp_extract(p, COPY_NAME, 1), F.regexp_extract(p, COPY_NAME, 3)).alias("target"),
            F.regexp_extract(p, COPY_NAME, 2).try_cast("long").alias("t")))
    taken = taken.where("t IS NOT NULL").join(targets, "target", "left_semi").distinct()
    slots = sequence_in_key(taken, ["target"], F.floor(F.col("t") / block), ["t"]).select(
        "target", F.lit(None).cast("string").alias("source"),
        (F.col("t") - F.col("seq") + 1).alias("pos"), F.lit(0).alias("kind"))
    ranked = sequence_by_range(moves.withColumn("_d", fx.dir_name(F.col("source"))), ["target"], ["_d", "source"]).select(
        "target", "source", (F.col("seq") - 1).alias("pos"), F.lit(1).alias("kind"))
    line = running_sum_in_key(slots.unionByName(ranked), ["target"], F.floor(F.col("pos") / block),
                              ["pos", "kind", "source"], (F.col("kind") == 0).cast("long"), "before")
    number = F.col("pos") + F.col("before")
    name = fx.base_name(F.col("target"))
    suffix = F.substr(name, F.length(fx.stem(name)) + 1)
    final = F.when(number == 0, F.col("target")).otherwise(fx.join_path(
        fx.dir_name(F.col("target")), F.concat(fx.stem(name), F.lit("("), number.cast("string"), F.lit(")"), suffix)))
    return line.where("kind = 1").select("source", "target", final.alias("final_target"))


def run_summary(files: DataFrame, plan: DataFrame) -> DataFrame:
    total = files.select(F.count("*").alias("n")).scalar()
    return plan.agg(
        F.countDistinct("path").alias("matched"), F.count("*").alias("operations"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed")).withColumn("total_files", total)


# ----------------------------------------------------------------- log, undo, bundle

def log_page(log: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return log.orderBy(F.desc("executed_at"), F.desc("id")).offset(offset).limit(limit)


def last_batch(log: DataFrame) -> DataFrame:
    return log.agg(F.max_by("batch_id", F.struct("executed_at", "id")).alias("batch_id"))


def undo_plan(log: DataFrame, batches: DataFrame) -> DataFrame:
    """Reverse steps for the successes of the given batches, newest first."""
    known = F.col("operation_type").isin("move", "rename", "copy", "backup", "zip")
    rows = log.join(batches.select("batch_id"), "batch_id", "left_semi").where("status = 'success'")
    return rows.select(
        "batch_id", "id", F.concat(F.lit("undo_"), "operation_type").alias("operation_type"),
        F.col("target_path").alias("source_path"), F.col("source_path").alias("target_path"),
        F.when(known, "planned").otherwise("skipped").alias("status")).orderBy("batch_id", F.desc("id"))


def rule_bundle(rules: DataFrame, conditions: DataFrame, actions: DataFrame) -> DataFrame:
    """Enabled rules with their ordered parts, one row per part."""
    def part(df: DataFrame, kind: str, k: str, v: str) -> DataFrame:
        seq = sequence_in_key(df, ["rule_id"], F.floor(F.col("sort_order") / 1000),
                              ["sort_order", "part_id"], "position")
        return seq.select("rule_id", F.lit(kind).alias("part"), "position",
                          F.col(k).alias("kind"), F.col(v).alias("value"))
    parts = part(conditions, "condition", "condition_type", "condition_value").unionByName(
        part(actions, "action", "action_type", "action_params"))
    live = rules.where("enabled").select(F.col("id").alias("rule_id"), "name", "priority")
    return live.join(parts, "rule_id", "left")


# ---------------------------------------------------------------------- templates

# Folders, extensions and priorities of the rule templates.
BY_EXTENSION = [
    ("图片", "jpg,jpeg,png,gif,bmp,webp,svg,ico", "Images"),
    ("文档", "pdf,doc,docx,xls,xlsx,ppt,pptx,txt,rtf,odt,ods,odp,md", "Documents"),
    ("视频", "mp4,avi,mkv,mov,wmv,flv,webm,m4v", "Videos"),
    ("音频", "mp3,wav,flac,aac,ogg,wma,m4a,aiff", "Audio"),
    ("压缩包", "zip,rar,7z,tar,gz,bz2,xz", "Archives"),
    ("代码", "py,js,ts,java,c,cpp,h,hpp,cs,go,rb,php,html,css,json,xml,yaml,yml", "Code"),
]
DOWNLOADS = [
    ("图片", "jpg,jpeg,png,gif,bmp,webp,svg", "图片", 50),
    ("文档", "pdf,doc,docx,xls,xlsx,ppt,pptx,txt,md", "文档", 40),
    ("视频", "mp4,avi,mkv,mov,wmv,flv,webm", "视频", 30),
    ("音频", "mp3,wav,flac,aac,ogg,m4a", "音乐", 20),
    ("压缩包", "zip,rar,7z,tar,gz", "压缩包", 10),
]
DOWNLOADS_DETAILED = [
    ("图片", "jpg,jpeg,png,gif,bmp,webp,svg,ico", "图片", 60),
    ("文档", "pdf,doc,docx,xls,xlsx,ppt,pptx,txt,rtf,md", "文档", 50),
    ("视频", "mp4,avi,mkv,mov,wmv,flv,webm,m4v", "视频", 40),
    ("音乐", "mp3,wav,flac,aac,ogg,wma,m4a", "音乐", 30),
    ("软件安装包", "exe,msi,dmg,pkg,deb,rpm,apk", "软件", 25),
    ("压缩包", "zip,rar,7z,tar,gz,bz2,xz", "压缩包", 20),
    ("代码", "py,js,ts,java,c,cpp,html,css,json,xml", "代码", 15),
    ("电子书", "epub,mobi,azw3,pdf", "电子书", 10),
]
TEMPORARY = "tmp,log,crdownload,part,dat,bak,old,temp,cache"
PHOTO_FOLDERS = {"year_month": "{modified_year}/{modified_month}",
                 "year_month_day": "{modified_year}/{modified_month}/{modified_day}",
                 "year_month_name": "{modified_year}-{modified_month}"}


def _ext(value: str) -> dict:
    return {"type": "extension", "value": value}


def extension_rules(base: str = "", only: str = "") -> list[Rule]:
    wanted = {e.strip().lower().lstrip(".") for e in only.split(",")} if only else None
    return [Rule(i + 1, f"按后缀分类 - {n}", 10 - i, conditions=[_ext(e)],
                 actions=[{"type": "move", "target_dir": base + folder}])
            for i, (n, e, folder) in enumerate(BY_EXTENSION)
            if wanted is None or wanted & set(e.split(","))]


def photo_rules(base: str = "", structure: str = "year_month", date_source: str = "modified") -> list[Rule]:
    path = PHOTO_FOLDERS[structure]
    if date_source == "created":
        path = path.replace("modified", "created")
    return [Rule(1, "按月份归档照片", 10, conditions=[{"type": "file_type", "value": "image"}],
                 actions=[{"type": "move", "target_dir": f"{base.rstrip('/')}/{path}" if base else path}])]


def cleanup_rules(action: str = "zip", target_dir: str = "temp_files", older_than: str = "30d") -> list[Rule]:
    conditions = [_ext(TEMPORARY)]
    if older_than:
        conditions.append({"type": "date_modified_to", "value": older_than})
    folder = "backup_dir" if action == "backup" else "target_dir"
    return [Rule(1, "清理临时文件", 5, conditions=conditions, actions=[{"type": action, folder: target_dir}])]


def music_rules(base: str = "") -> list[Rule]:
    return [Rule(1, "音乐按艺术家整理", 10, conditions=[{"type": "file_type", "value": "audio"}],
                 actions=[{"type": "move", "target_dir": base + "Music/{artist}/{album}"}])]


def download_rules(base: str = "", detailed: bool = False) -> list[Rule]:
    table = DOWNLOADS_DETAILED if detailed else DOWNLOADS
    rules = [Rule(i + 1, f"下载分类 - {n}", p, conditions=[_ext(e)],
                  actions=[{"type": "move", "target_dir": base + folder}])
             for i, (n, e, folder, p) in enumerate(table)]
    return rules + [Rule(len(rules) + 1, "下载分类 - 其他", 1,
                         actions=[{"type": "move", "target_dir": base + "其他"}])]


TEMPLATES = {"extension": extension_rules, "photo": photo_rules, "cleanup": cleanup_rules,
             "music": music_rules, "downloads": download_rules}
