"""Corpus files and stored snapshots."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessella.operators import ordered
from tessella.sources import corpus, files, snapshots


def test_read_what_can_be_read(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    for name, data in {"a.txt": "北京 utf".encode(), "sub/b.TXT": "北京 gbk".encode("gbk"), "c.txt": b"\xff\xff\xff", "d.txt": b"",
                       "e.md": b"other"}.items():
        (folder / name).write_bytes(data)
    got = {r["name"]: (r["content"], r["encoding"], r["size"], r["error"]) for r in files.corpus(
        spark, path=str(folder), extension="txt", partitionFiles="2").collect()}
    assert got == {"a.txt": ("北京 utf", "utf-8", 10, None), "b.TXT": ("北京 gbk", "gbk", 8, None),
                   "c.txt": (None, None, 3, "neither utf-8 nor gbk"), "d.txt": ("", "utf-8", 0, None)}
    assert {r["name"]: r["content"] for r in files.corpus_scan(spark, f"file://{folder}").collect()} == {k: v[0] for k, v in got.items()}
    gone = files.corpus(spark, paths=f"{folder}/e.md\n{folder}/gone").collect()
    assert sorted((r["name"], r["content"], r["error"]) for r in gone) == [("e.md", "other", None), ("gone", None, "FileNotFoundError")]
    (tmp_path / "empty").mkdir()
    assert files.corpus_scan(spark, str(tmp_path / "empty")).count() == 0


def test_partitions_by_size_and_pruning_by_name():
    sizes = [("x", 10), ("y", 70), ("z", 5), ("w", 200), ("v", -1)]
    assert [[p for p, _ in f.paths] for f in corpus.packed(sizes, 80, 3)] == [["w"], ["y", "x"], ["z", "v"]]
    assert [len(f.paths) for f in corpus.packed([(str(i), 0) for i in range(7)], 80, 3)] == [3, 3, 1] and corpus.packed([], 1, 1) == []
    reader = corpus.CorpusReader({"path": "/", "extension": "TXT"})
    kept = list(reader.pushFilters([corpus.EqualTo(("name",), "a.txt"), corpus.EqualTo(("size",), 3), corpus.StringStartsWith(("path",), "/q")]))
    assert [f.attribute for f in kept] == [("size",)]
    assert reader.wanted("/q/a.txt") and not reader.wanted("/r/a.txt") and not reader.wanted("/q/b.txt") and not reader.wanted("/q/a.md")


def test_pruned_files_are_not_listed_into_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i}.txt", f"text {i}", "utf-8") for i in range(20)], "name string, content string, encoding string")
    files.write_files(rows.repartition(3), str(tmp_path / "c"))
    assert sorted(os.listdir(tmp_path / "c")) == sorted(f"p{i}.txt" for i in range(20))  # no staging is left
    one = files.corpus(spark, path=str(tmp_path / "c"), partitionFiles="1").where("name = 'p7.txt'")
    assert [r["content"] for r in one.collect()] == ["text 7"] and one.rdd.getNumPartitions() == 1


def test_snapshots_are_committed_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "s")
    assert snapshots.versions(spark, path) == []
    with pytest.raises(ValueError):
        snapshots.load(spark, path)
    a, b = spark.range(3), spark.range(5)
    assert snapshots.save(a, path, note="first") == 1
    b.write.parquet(f"{path}/data-lost")  # a writer that failed before its commit
    (tmp_path / "s/_manifests/000000000002.json.x.tmp").write_text('{"version": 2, "data"')  # and one that failed within it
    assert snapshots.versions(spark, path) == [1] and snapshots.load(spark, path).count() == 3
    assert snapshots.save(b, path) == 2 and snapshots.load(spark, path).count() == 5 and snapshots.load(spark, path, 1).count() == 3
    assert snapshots.describe(spark, path, 1)["note"] == "first"
    with pytest.raises(ValueError):
        snapshots.load(spark, path, 7)


def test_of_two_writers_one_takes_the_next_number(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    snapshots.save(spark.range(1), path)
    real, late = snapshots.versions, []

    def seen(spark_, path_):
        found = real(spark_, path_)
        if not late:  # between its look and its commit another writer commits
            late.append(1)
            assert snapshots.commit(spark, path, "data-other", {}) == 2
        return found
    monkeypatch.setattr(snapshots, "versions", seen)
    assert snapshots.commit(spark, path, "data-own", {}) == 3
    names = sorted(x for x in os.listdir(tmp_path / "s/_manifests") if not x.startswith("."))
    assert names == [f"{n:012d}.json" for n in (1, 2, 3)]
    assert json.loads((tmp_path / "s/_manifests" / names[1]).read_text())["data"] == "data-other"


def test_ranks_in_a_folder_that_holds_most_rows(spark):
    """Nine in ten rows are of one key and one folder; no partition holds much more than the middle one."""
    df = spark.range(20_000).select(F.expr("IF(id % 10 = 0, concat('k', id % 7), 'hot')").alias("target"), F.lit("/same").alias("d"),
                                    F.concat(F.lit("f"), F.expr("lpad(string(id * 7919 % 20011), 6, '0')")).alias("source"))
    got = ordered.sequence_by_range(df.repartition(7), ["target"], ["d", "source"]).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["source"]):
        by.setdefault(r["target"], []).append(r["seq"])
    assert len(got) == 20_000 and all(x == list(range(1, len(x) + 1)) for x in by.values())
    sizes = sorted(df.repartitionByRange(8, "target", "d", "source").groupBy(F.spark_partition_id()).count().toPandas()["count"])
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert ordered.sequence_by_range(df.limit(0), ["target"], ["source"]).count() == 0
