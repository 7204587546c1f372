"""Components against union-find, collisions against a plain loop, rule parsing."""

import random

from pyspark.sql import functions as F

from tessella.functions import files as fx
from tessella.operators import graph, rules


def test_components_and_reachable(spark):
    rng = random.Random(5)
    n = 60
    edges = [(i, i + 1) for i in range(20)] + [(rng.randint(21, n - 1), rng.randint(21, n - 1)) for _ in range(25)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    name = lambda i: f"n{i:03d}"
    nodes = spark.createDataFrame([(name(i),) for i in range(n)], "note_id string")
    links = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "src string, dst string")
    got = {r["node"]: r["component"] for r in graph.components(nodes, links).collect()}
    assert got == {name(i): name(find(i)) for i in range(n)}
    far = {r["node"] for r in graph.reachable(nodes, links, name(0), max_hops=3).collect()}
    assert far == {name(i) for i in range(21)}


def test_collisions(spark):
    moves = [(f"/in/d{i % 5}/f{i}.txt", "/out/a.txt") for i in range(25)] + [("/in/x.txt", "/out/b.txt"), ("/in/y", "/out/.rc")]
    existing = ["/out/a.txt", "/out/a(2).txt", "/out/a(7).txt", "/out/a(30).txt"]
    taken, want = set(existing), {}
    for source, target in sorted(moves, key=lambda m: (m[0].rsplit("/", 1)[0], m[0])):
        name, k = target, 0
        while name in taken:
            k += 1
            name = target.replace(".txt", f"({k}).txt")
        taken.add(name)
        want[source] = name
    got = rules.target_collisions(spark.createDataFrame(moves, "source string, target string"),
                                  spark.createDataFrame([(e,) for e in existing], "path string"), block=3)
    assert {r["source"]: r["final_target"] for r in got.collect()} == want


def test_rules_from_tables(spark):
    r = spark.createDataFrame([(1, "a", 5, True, "AND"), (2, "b", 9, False, "AND"), (3, "c", 1, True, "NOT")],
                              "id int, name string, priority int, enabled boolean, logic_operator string")
    c = spark.createDataFrame([(1, "extension", "jpg,png", False, 0), (1, "file_size_min", "1KB", False, 1),
                               (2, "extension", "txt", False, 0), (3, "regex", "^REPORT", False, 0)],
                              "rule_id int, condition_type string, condition_value string, negate boolean, sort_order int")
    a = spark.createDataFrame([(1, "move", {"target_dir": "Images"}, 0)],
                              "rule_id int, action_type string, action_params map<string,string>, sort_order int")
    book = rules.load_rules(r, c, a)
    files = spark.createDataFrame(
        [("/d/test.jpg", "test.jpg", "jpg", 1024), ("/d/document.txt", "document.txt", "txt", 500), ("/d/report.pdf", "report.pdf", "pdf", 3000)],
        "path string, name string, extension string, size long").withColumns({
            "modified_time": F.current_timestamp(), "created_time": F.current_timestamp(), "parent": F.lit("/d")})
    best = {x["path"]: x["rule_id"] for x in rules.match_first(files, book, "2024-01-30").collect()}
    assert best == {"/d/test.jpg": 1, "/d/document.txt": 3}
    plan = rules.action_plan(files, book, "2024-01-30").collect()
    assert [(p["source"], p["target"]) for p in plan] == [("/d/test.jpg", "/d/Images/test.jpg")]


def test_path_expressions(spark):
    df = spark.createDataFrame([("/a/b/../c/./d.py",), ("/../x",)], "p string")
    assert [r[0] for r in df.select(fx.normal_path(F.col("p"))).collect()] == ["/a/c/d.py", "/x"]
    names = ["my_file.py", "my-file.js", "README", "readme", "MAX_SIZE.h", "2024-01-05 x.txt", "a b.12.txt",
             "unit test.py", "read me.md", ".bashrc"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(
        fx.naming_pattern(F.col("n"))).collect()]
    assert got == ["snake_case", "kebab-case", "PascalCase", "camelCase", "UPPER_SNAKE_CASE", "date_prefix",
                   "numbered_suffix", "test_file", "mixed", "mixed"]
