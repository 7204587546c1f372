"""Column expressions over paths, names and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.data import filetypes as ft

SPLIT_NAME = r"^(\.*(?:[^.].*?)?)(\.[^.]*)?$"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def stem(name: Column) -> Column:
    return F.regexp_extract(name, SPLIT_NAME, 1)


def extension(name: Column) -> Column:
    return F.ltrim(F.lower(F.regexp_extract(name, SPLIT_NAME, 2)), F.lit("."))


def category(ext: Column) -> Column:
    out = None
    for name, exts in ft.CATEGORIES.items():
        hit = ext.isin(*exts.split())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def size_bucket(size: Column) -> Column:
    out = None
    for limit, label in ft.SIZE_BUCKETS:
        out = F.when(size < limit, label) if out is None else out.when(size < limit, label)
    return out.otherwise(ft.LARGEST_BUCKET)


def size_label(size: Column) -> Column:
    """B as it is, then KB, MB, GB with two decimals."""
    def scaled(power: int, unit: str) -> Column:
        hundredths = F.round(size * 100 / float(1024 ** power)).cast("long")
        return F.concat((hundredths / 100).cast("long").cast("string"), F.lit("."),
                        F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(f" {unit}"))
    return (F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
            .when(size < 1024 ** 2, scaled(1, "KB")).when(size < 1024 ** 3, scaled(2, "MB"))
            .otherwise(scaled(3, "GB")))


def naming_pattern(name: Column) -> Column:
    s = stem(name)
    low = F.lower(s)
    out = None
    for style, pattern in ft.NAMING:
        out = F.when(s.rlike(pattern), style) if out is None else out.when(s.rlike(pattern), style)
    return (out.when(low.rlike("|".join(ft.TEST_HINTS)), "test_file")
            .when(low.rlike("^(" + "|".join(ft.DOC_HINTS) + ")"), "project_doc")
            .when(low.rlike(r"^(dockerfile|makefile|\.env)"), "build_config").otherwise("mixed"))


def ignored(path: Column, name: Column) -> Column:
    pattern = "|".join(ft.IGNORED)
    return name.startswith(".") | path.rlike(pattern) | name.rlike(pattern)


def normal_path(path: Column) -> Column:
    """Resolve '.' and '..' of an absolute path."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda acc, p: F.when(
        p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
        F.array_append(acc, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def join_path(folder: Column, name: Column) -> Column:
    return F.when(name.startswith("/"), name).otherwise(F.concat(folder, F.lit("/"), name))


def imports(ext: Column, text: Column, compat: bool = False) -> Column:
    """Distinct imported names by language. `compat` keeps a known quirk of the
    application: for 'import x' in Python it reports the word import."""
    out = None
    for family, (exts, pattern) in ft.IMPORTS.items():
        found = F.regexp_extract_all(text, F.lit(pattern), 1)
        if family == "py" and compat:
            found = F.transform(
                F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*((?:from|import)[ \t]+[\w.]+)"), 1),
                lambda s: F.when(s.startswith("import"), "import").otherwise(
                    F.regexp_extract(s, r"([\w.]+)$", 1)))
        if family == "go":  # a quoted string is an import when its first part is a host
            found = F.filter(found, lambda s: s.rlike(r"^[^/]*\.[^/]*/"))
        hit = ext.isin(*exts.split())
        out = F.when(hit, found) if out is None else out.when(hit, found)
    return F.array_distinct(F.coalesce(out, F.expr("cast(array() as array<string>)")))


def parse_size(text: Column) -> Column:
    """'10MB' → bytes, NULL when it is not a size."""
    s = F.upper(F.trim(text))
    number = F.trim(F.regexp_extract(s, r"(?s)^(.*?)(KB|MB|GB|B)?$", 1)).try_cast("double")
    unit = F.regexp_extract(s, r"(?s)^(.*?)(KB|MB|GB|B)?$", 2)
    factor = (F.when(unit == "KB", 1024).when(unit == "MB", 1024 ** 2)
              .when(unit == "GB", 1024 ** 3).otherwise(1))
    return (number * factor).try_cast("long")


WHEN_FORMATS = ["yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "yyyy/M/d H:m:s", "yyyy/M/d"]


def parse_when(text: Column, as_of: str) -> Column:
    """Five date formats or '30d' before as_of; NULL when neither."""
    s = F.trim(text)
    days = F.regexp_extract(s, r"^([+-]?\d+)[dD]$", 1).try_cast("int")
    parsed = [F.try_to_timestamp(s, F.lit(f)) for f in WHEN_FORMATS]
    return F.coalesce(*parsed, F.timestamp_add("DAY", -days, F.lit(as_of).cast("timestamp")))
