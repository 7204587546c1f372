"""File inventories: one row per file, the tree is the path itself.

(path, name, extension, size, modified_time, created_time, parent, depth) is
the contract; `described` adds category, size bucket and naming style map-only.
Directory facts come from the distinct parents, so a directory that holds a
third of all files is one row before anything is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.data import filetypes as ft
from tessella.functions import files as fx
from tessella.functions.bounds import fixed_table
from tessella.functions.rows import settled, unnest
from tessella.session import cut


def described(files: DataFrame) -> DataFrame:
    return files.withColumns({
        "category": fx.category(F.col("extension")),
        "size_bucket": fx.size_bucket(F.col("size")),
        "naming": fx.naming_pattern(F.col("name"))})


def signatures(files: DataFrame) -> DataFrame:
    return files.withColumn("signature", F.md5(F.concat_ws(
        "|", "path", "size", F.unix_timestamp("modified_time"))))


def keep_scanned(files: DataFrame) -> DataFrame:
    return files.where(~fx.ignored(F.col("path"), F.col("name")))


# ------------------------------------------------------------------ dependencies

def source_imports(texts: DataFrame, compat: bool = False) -> DataFrame:
    """(path, extension, text) → (path, import)."""
    return unnest(texts, ["path"], fx.imports(F.col("extension"), F.col("text"), compat), "import")


def dependency_edges(imports: DataFrame, code_paths: DataFrame) -> DataFrame:
    """Imports that resolve to a known code file relative to the importer."""
    target = fx.normal_path(fx.join_path(fx.dir_name(F.col("path")), F.col("import")))
    known = code_paths.select(F.col("path").alias("dst"))
    return (imports.select(F.col("path").alias("src"), target.alias("dst"))
            .join(known, "dst", "left_semi").select("src", "dst"))


def hotspots(edges: DataFrame, at_least: int = 3, k: int = 5) -> DataFrame:
    return (edges.groupBy("dst").agg(F.count("*").alias("dependents"))
            .where(F.col("dependents") >= at_least)
            .orderBy(F.desc("dependents"), F.asc("dst")).limit(k))


def module_cohesion(edges: DataFrame, code_files: DataFrame) -> DataFrame:
    """Per directory with at least two code files: internal and external edges,
    cohesion, and whether it is a module (as many internal edges as files)."""
    sizes = code_files.groupBy(F.col("parent").alias("directory")).agg(F.count("*").alias("files"))
    total = code_files.select(F.count("*").alias("n")).scalar()
    src = fx.dir_name(F.col("src"))
    links = edges.groupBy(src.alias("directory")).agg(
        F.count_if(fx.dir_name(F.col("dst")) == src).alias("internal"),
        F.count_if(fx.dir_name(F.col("dst")) != src).alias("external"))
    rows = sizes.where((F.col("files") >= 2) & (total >= 3)).join(links, "directory", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("internal", "external")})
    return rows.withColumns({
        "cohesion": F.col("internal") / F.greatest(F.col("internal") + F.col("external"), F.lit(1)),
        "is_module": F.col("internal") >= F.col("files")})


def module_clusters(edges: DataFrame, code_files: DataFrame) -> DataFrame:
    """(directory, path) of the files of every module."""
    modules = module_cohesion(edges, code_files).where("is_module").select("directory")
    return code_files.select(F.col("parent").alias("directory"), "path").join(
        modules, "directory", "left_semi")


# -------------------------------------------------------------------- statistics

def directories(files: DataFrame, root: str) -> DataFrame:
    """Every directory below the root that holds something, with its parent."""
    parents = files.select("parent").distinct().where(F.col("parent") != root)
    rest = F.split(F.expr(f"substring(parent, {len(root) + 2})"), "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(rest)), lambda i: F.concat(
        F.lit(root + "/"), F.array_join(F.slice(rest, 1, i), "/")))
    dirs = parents.select(F.explode(chain).alias("directory")).distinct()
    return dirs.withColumn("above", fx.dir_name(F.col("directory")))


def directory_stats(files: DataFrame, root: str) -> DataFrame:
    n_dirs = directories(files, root).select(F.count("*").alias("n")).scalar()
    return files.agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"),
                     F.max("depth").cast("long").alias("max_depth")).select(
        "files", n_dirs.alias("dirs"), "bytes", "max_depth",
        (F.col("files") / F.greatest(n_dirs, F.lit(1))).alias("avg_files_per_dir"))


def distributions(files: DataFrame) -> DataFrame:
    """(metric, key, n) for five groupings in one pass."""
    rows = described(files).select(
        F.col("extension").alias("by_extension"), F.col("category").alias("by_category"),
        F.col("size_bucket").alias("by_size"), F.col("depth").cast("string").alias("by_depth"),
        F.col("naming").alias("by_naming"))
    cols = rows.columns
    sets = rows.groupingSets([[F.col(c)] for c in cols], *cols).agg(
        F.count("*").alias("n"), F.grouping_id().alias("gid"))
    metric = reduce(lambda acc, ic: acc.when(
        F.col("gid") == (31 - (16 >> ic[0])), ic[1]), list(enumerate(cols))[1:],
        F.when(F.col("gid") == 15, cols[0]))
    return sets.select(metric.alias("metric"), F.coalesce(*cols).alias("key"), "n")


def report_distributions(files: DataFrame, top_extensions: int = 20) -> DataFrame:
    dist = distributions(files)
    ext = dist.where("metric = 'by_extension'").orderBy(F.desc("n"), F.asc("key")).limit(top_extensions)
    return dist.where("metric <> 'by_extension'").unionByName(ext)


def naming_consistency(code_files: DataFrame) -> DataFrame:
    """Share of the most frequent style; ties go to the first style by name."""
    per = code_files.where("extension <> ''").groupBy("naming").agg(F.count("*").alias("n"))
    top = per.agg(F.max("n").alias("n"), F.sum("n").alias("total"), F.count("*").alias("styles"))
    first = per.join(top.select("n"), "n", "left_semi").agg(F.min("naming").alias("dominant"))
    return top.select(first.scalar().alias("dominant"), (F.col("n") / F.col("total")).alias("score"),
                      "styles").withColumn(
        "verdict", F.when(F.col("score") >= 0.8, "consistent")
        .when(F.col("score") >= 0.5, "mostly_consistent").otherwise("inconsistent"))


def naming_outliers(code_files: DataFrame) -> DataFrame:
    """Files whose style is unique within an extension that has several styles."""
    rows = code_files.where("extension <> ''")
    per = rows.groupBy("extension", "naming").agg(
        F.count("*").alias("n"), F.min("path").alias("path"))
    styles = per.groupBy("extension").agg(F.count("*").alias("styles")).where("styles > 1")
    return per.where("n = 1").join(styles, "extension", "left_semi").select(
        "path", "extension", "naming")


def large_files(files: DataFrame, limit: int = ft.LARGE_FILE) -> DataFrame:
    return files.where(F.col("size") > limit)


def direct_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.col("parent").alias("directory")).agg(F.count("*").alias("files"))


def sparse_dirs(files: DataFrame, root: str) -> DataFrame:
    """Directories below the root with at most one file and no directory."""
    dirs = directories(files, root)
    with_subdirs = dirs.select(F.col("above").alias("directory")).distinct()
    return (dirs.join(direct_counts(files), "directory", "left")
            .where(F.coalesce("files", F.lit(0)) <= 1)
            .join(with_subdirs, "directory", "left_anti").select("directory"))


def crowded_dirs(files: DataFrame, threshold: int = 30) -> DataFrame:
    return direct_counts(files).where(F.col("files") > threshold)


FLAGS = ("root_files", "flat_code", "docs", "images", "tests_in_place", "stray_tests")


def _told(files: DataFrame) -> DataFrame:
    """Category and naming style, to be read many times over."""
    return settled(settled(files, "category", fx.category(F.col("extension"))), "naming", fx.naming_pattern(F.col("name")))


def inventory_facts(files: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(kind, a, b, n, path, depth and a column per flag): every count that findings and
    recommendations need, from one pass over the files and one over the edges. A file
    gives a row for each group it counts in; rows are combined where they arise, so what is
    shuffled and kept is a row per directory, style and large file.

    Kinds: all; parent (a: directory); naming (a: style) and style (a: extension, b: style)
    of code with an extension; code_dir (a: directory); large (a: path); dst (a: file that
    others import); link (a: directory, b: whether the import stays in it)."""
    shallow, code = F.col("depth") <= 1, F.col("category") == "code"
    test, none = code & (F.col("naming") == "test_file"), F.lit(None).cast("string")
    flag = dict(zip(FLAGS, (
        (F.col("depth") == 1) & F.col("category").isin("code", "document", "image", "audio", "video"),
        shallow & code, shallow & (F.col("category") == "document") & (F.col("naming") != "project_doc"),
        shallow & (F.col("category") == "image"), test & F.lower(fx.base_name(F.col("parent"))).contains("test"),
        test & (F.col("depth") <= 2))))

    def group(kind: str, a: Column, b: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    named = code & (F.col("extension") != "")
    groups = F.array(group("all", none), group("parent", F.col("parent")), F.when(named, group("naming", F.col("naming"))),
                     F.when(named, group("style", F.col("extension"), F.col("naming"))),
                     F.when(code, group("code_dir", F.col("parent"))),
                     F.when(F.col("size") > ft.LARGE_FILE, group("large", F.col("path"))))
    rows = _told(files).select("path", "depth", *[F.coalesce(c, F.lit(False)).alias(f) for f, c in flag.items()],
                                   F.explode(F.array_compact(groups)).alias("g"))
    facts = rows.groupBy("g.kind", "g.a", "g.b").agg(
        F.count("*").alias("n"), F.min("path").alias("path"), F.max("depth").cast("long").alias("depth"),
        *[F.count_if(f).alias(f) for f in FLAGS])
    if edges is not None:
        here, there = fx.dir_name(F.col("src")), fx.dir_name(F.col("dst"))
        links = edges.select(F.explode(F.array(group("dst", F.col("dst")), group("link", here, (here == there).cast("string")))).alias("g"))
        facts = facts.unionByName(links.groupBy("g.kind", "g.a", "g.b").agg(F.count("*").alias("n")), allowMissingColumns=True)
    return cut(facts)


def _of(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind)


def _directories(facts: DataFrame, root: str) -> DataFrame:
    return directories(_of(facts, "parent").select(F.col("a").alias("parent")), root)


def _totals(facts: DataFrame, root: str) -> DataFrame:
    """One row: the flags, files, max_depth, crowded directories, naming score and styles,
    imported files, directories and files per directory."""
    kind = F.col("kind")
    n_dirs = _directories(facts, root).select(F.count("*").alias("n")).scalar()
    naming = F.when(kind == "naming", F.col("n"))
    row = facts.agg(*[F.sum(F.when(kind == "all", F.col(f))).alias(f) for f in FLAGS],
                    F.sum(F.when(kind == "all", F.col("n"))).alias("files"), F.max(F.when(kind == "all", F.col("depth"))).alias("max_depth"),
                    F.count_if((kind == "parent") & (F.col("n") > 30)).alias("crowded"),
                    (F.max(naming) / F.sum(naming)).alias("score"), F.count(naming).alias("styles"),
                    F.count_if((kind == "dst") & (F.col("n") >= 3)).alias("hot"))
    return row.withColumn("avg_files_per_dir", F.col("files") / F.greatest(n_dirs, F.lit(1)))


def _findings(facts: DataFrame, root: str) -> DataFrame:
    """(type, severity, path)."""
    totals = _totals(facts, root)
    none = F.lit(None).cast("string")

    def finding(df: DataFrame, kind: str, severity: str, path: Column = none) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), path.alias("path"))
    dirs = _directories(facts, root)
    inner = dirs.select(F.col("above").alias("directory")).distinct()
    sparse = (dirs.join(_of(facts, "parent").select(F.col("a").alias("directory"), "n"), "directory", "left")
              .where(F.coalesce("n", F.lit(0)) <= 1).join(inner, "directory", "left_anti"))
    return reduce(DataFrame.unionByName, [
        finding(totals.where("avg_files_per_dir > 50"), "too_many_files_per_dir", "warning"),
        finding(totals.where("max_depth > 10"), "deep_nesting", "warning"),
        finding(_of(facts, "large").select(F.explode(F.array_repeat("a", F.col("n").cast("int"))).alias("a")), "large_file", "info", F.col("a")),
        finding(sparse, "empty_or_single_file_dir", "info", F.col("directory")),
        finding(totals.where("flat_code > 10"), "flat_code_structure", "warning")])


def anomalies(files: DataFrame, root: str) -> DataFrame:
    """(type, severity, path) findings."""
    return _findings(inventory_facts(files), root)


# --------------------------------------------------------------- recommendations

ANOMALY_GROUPS = {"too_many_files_per_dir": "structure", "deep_nesting": "structure",
                  "large_file": "performance", "empty_or_single_file_dir": "structure",
                  "flat_code_structure": "organization"}


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in ft.SEVERITIES]), severity),
                      F.lit(6)) - 1


def recommendations(files: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """(type, severity, area, affected, path, rank) rows, all from one table of facts."""
    facts = inventory_facts(files, edges)
    styles = _of(facts, "style").groupBy("a").agg(F.count("*").alias("styles"), F.count_if(F.col("n") == 1).alias("lone"))
    outliers = styles.where("styles > 1").agg(F.coalesce(F.sum("lone"), F.lit(0)).alias("n")).scalar()
    inside = F.when((F.col("kind") == "link") & (F.col("b") == "true"), F.col("n")).otherwise(0)
    per_dir = facts.where("kind IN ('code_dir', 'link')").groupBy("a").agg(
        F.sum(F.when(F.col("kind") == "code_dir", F.col("n")).otherwise(0)).alias("files"), F.sum(inside).alias("internal"))
    modules = per_dir.agg(F.when(F.sum("files") >= 3, F.count_if((F.col("files") >= 2) & (F.col("internal") >= F.col("files")))).otherwise(0).alias("n")).scalar()
    rows = _totals(facts, root).withColumns({"outliers": F.least(outliers, F.lit(20)), "modules": modules})
    col, zero = F.col, F.lit(0)
    # (type, severity, area, condition, affected)
    rules = [
        ("directory_structure", "warning", "structure", (col("avg_files_per_dir") > 30) & (col("crowded") > 0), col("crowded")),
        ("deep_nesting", "warning", "structure", col("max_depth") > 8, zero),
        ("file_categorization", "warning", "organization", col("root_files") > 5, col("root_files")),
        ("code_organization", "warning", "organization", col("flat_code") > 10, col("flat_code")),
        ("document_organization", "info", "organization", col("docs") > 3, col("docs")),
        ("asset_organization", "info", "organization", col("images") > 3, col("images")),
        ("naming_inconsistency", "warning", "naming", col("score") < 0.5, col("outliers")),
        ("multiple_naming_styles", "info", "naming", col("styles") > 3, zero),
        ("module_detection", "info", "architecture", col("modules") > 0, zero),
        ("dependency_hotspots", "info", "architecture", (col("modules") > 0) & (col("hot") > 0), F.least(col("hot"), F.lit(5))),
        ("test_organization", "info", "organization", (col("tests_in_place") == 0) & (col("stray_tests") > 0), col("stray_tests")),
    ]
    made = rows.select(F.explode(F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(a).alias("area"),
                              n.cast("long").alias("affected"))) for t, s, a, cond, n in rules]))).alias("r"))
    area = F.create_map(*[F.lit(x) for kv in ANOMALY_GROUPS.items() for x in kv])
    return made.select("r.*", F.lit(None).cast("string").alias("path")).unionByName(
        _findings(facts, root).select(F.concat(F.lit("anomaly_"), "type").alias("type"), "severity",
                                      F.element_at(area, F.col("type")).alias("area"),
                                      F.col("path").isNotNull().cast("long").alias("affected"), "path")
    ).withColumn("rank", severity_rank(F.col("severity")))


def target_layout(files: DataFrame, root: str) -> DataFrame:
    """Where files directly under the root should move."""
    rows = _told(files.where("depth = 1"))
    cat = F.col("category")
    folder = (F.when((cat == "code") & (F.col("naming") == "test_file"), "tests")
              .when(cat == "code", "src")
              .when((cat == "document") & (F.col("naming") == "project_doc"), None))
    for name, where in ft.CATEGORY_DIRS.items():
        folder = folder.when(cat == name, f"assets/{where}" if name in ("image", "audio", "video") else where)
    return (rows.withColumn("folder", folder).where("folder IS NOT NULL")
            .select(F.col("path").alias("source"),
                    F.concat(F.lit(root + "/"), "folder", F.lit("/"), "name").alias("target"))
            .where("source <> target"))


def language_mix(code_files: DataFrame, spark: SparkSession, k: int = 3) -> DataFrame:
    names = fixed_table(spark, [(e, n, ft.PREFERRED_NAMING.get(n)) for e, n in ft.LANGUAGES.items()],
                        "extension string, language string, preferred string")
    per = code_files.groupBy("extension").agg(F.count("*").alias("n")).join(names, "extension")
    return (per.groupBy("language", "preferred").agg(F.sum("n").alias("files"))
            .orderBy(F.desc("files"), F.asc("language")).limit(k))


def suggested_rules(files: DataFrame, spark: SparkSession) -> DataFrame:
    """One move rule per category that occurs, one for test files."""
    seed = [(c, f"智能推荐 - {label}归类", 50, "extension", exts, folder)
            for c, exts, folder, label in ft.SUGGESTED]
    seed.append(("test_file", "智能推荐 - 测试文件归集", 45, "filename_keyword",
                 "test,spec,__tests__,unittest", "tests"))
    table = fixed_table(spark, seed, "present string, name string, priority int, "
                        "condition_type string, condition_value string, target_dir string")
    rows = described(files)
    present = rows.select(F.explode(F.array(
        "category", F.when(F.col("naming") == "test_file", "test_file"))).alias("present")).distinct()
    return present.join(table, "present").drop("present")


def tree_cut(files: DataFrame, root: str, max_depth: int = 4, shown: int = 50) -> DataFrame:
    """The tree as displayed: children per directory, directories first, cut by
    depth and count; `hidden` is the overflow of the parent."""
    dirs = directories(files, root)
    children = dirs.select(F.col("above").alias("parent"), F.col("directory").alias("path"),
                           F.lit(True).alias("is_dir")).unionByName(
        files.select("parent", "path", F.lit(False).alias("is_dir")))
    depth = lambda c: F.size(F.split(c, "/")) - F.size(F.split(F.lit(root), "/"))
    children = children.where(depth(F.col("parent")) <= max_depth)
    total = children.groupBy("parent").agg(F.count("*").alias("n"))
    w = Window.partitionBy("parent").orderBy(F.desc("is_dir"), F.asc("path"))
    top = children.withColumn("position", F.row_number().over(w)).where(F.col("position") <= shown)
    return top.join(total, "parent").select(
        "parent", "path", "is_dir", "position",
        F.greatest(F.col("n") - shown, F.lit(0)).alias("hidden"))


# --------------------------------------------------------------------- snapshots

def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, signature, size, category) against the same; one row per path."""
    o = old.select("path", F.col("signature").alias("o_sig"), F.col("size").alias("old_size"))
    n = new.select("path", F.col("signature").alias("n_sig"), F.col("size").alias("new_size"), "category")
    change = (F.when(F.col("o_sig").isNull(), "added").when(F.col("n_sig").isNull(), "removed")
              .when(F.col("o_sig") != F.col("n_sig"), "modified").otherwise("unchanged"))
    return o.join(n, "path", "full_outer").select(
        "path", change.alias("change"), F.coalesce("old_size", F.lit(0)).alias("old_size"),
        F.coalesce("new_size", F.lit(0)).alias("new_size"), "category")


def snapshot_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("files"))


def change_hints(diff: DataFrame) -> DataFrame:
    """(hint, category, n) from one aggregation over change and category."""
    big = F.abs(F.col("new_size") - F.col("old_size")) > 1024 * 1024
    per = diff.groupBy("change", "category").agg(F.count("*").alias("n"), F.count_if(big).alias("big"))
    added = per.where("change = 'added' AND n >= 3").select(
        F.lit("bulk_add").alias("hint"), "category", "n")
    all_kinds = per.agg(
        F.sum(F.when(F.col("change") == "modified", F.col("big"))).alias("big"),
        F.coalesce(F.sum(F.when(F.col("change") == "removed", F.col("n"))), F.lit(0)).alias("removed"),
        F.coalesce(F.sum(F.when(F.col("change") == "added", F.col("n"))), F.lit(0)).alias("added"))
    full = (F.col("removed") > 0) | (F.col("added") > 10)
    rest = all_kinds.select(F.explode(F.array_compact(F.array(
        F.when(F.col("big") > 0, F.struct(F.lit("large_modifications").alias("hint"), F.col("big").alias("n"))),
        F.when(F.col("removed") > 0, F.struct(F.lit("files_removed").alias("hint"), F.col("removed").alias("n"))),
        F.when(full, F.struct(F.lit("full_rescan").alias("hint"), (F.col("removed") + F.col("added")).alias("n")))))
    ).alias("h")).select("h.hint", F.lit(None).cast("string").alias("category"), "h.n")
    return added.unionByName(rest)
