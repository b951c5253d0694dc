import bz2
import json
import os

import pytest
from pyspark.sql import functions as F

from chunkwright import cli
from chunkwright.operators import analysis, cost, textprep, wholefile
from chunkwright.operators.chunking import SMALL
from chunkwright.operators.store import Store, reset
from chunkwright.sources import files as S
from chunkwright.streaming.ingest import into_store


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "a.txt").write_bytes(b"shared payload block\n" * 1000)
    (root / "sub" / "b.txt").write_bytes(b"shared payload block\n" * 1000)
    (root / "_under.txt").write_bytes(b"under " * 500)
    (root / "empty").write_bytes(b"")
    (root / ".dot").write_bytes(b"x")
    (root / ".hidden" / "c").write_bytes(b"y")
    os.symlink(root / "a.txt", root / "link")
    os.symlink(root / "sub", root / "folder_link")
    return str(root)


def test_listing(spark, tree):
    names = sorted(os.path.basename(p) for p, _ in S.walk(tree))
    assert names == ["_under.txt", "a.txt", "b.txt", "empty", "link"]
    assert {".dot", "c"} <= {os.path.basename(p) for p, _ in S.walk(tree, True)}
    got = {os.path.basename(r.path): bytes(r.content) for r in S.read_files(spark, tree).collect()}
    assert got["empty"] == b"" and got["_under.txt"] == b"under " * 500
    assert S.scanned_folders(S.list_files(spark, tree)).first()[0] == 2
    with pytest.raises(ValueError):
        S.list_files(spark, tree + "/none", strict=True)


def test_store_lifecycle(spark, tree, tmp_path):
    s = Store(spark, str(tmp_path / "store"), SMALL, container_bytes=2000)
    s.ingest(S.read_files(spark, tree), "one")
    first = s.statistics("one").first()
    s.ingest(S.read_files(spark, tree), "one")  # the same again counts nothing
    assert s.statistics("one").first().total_refs == first.total_refs and first.files == 5
    assert s.audit().count() == 0
    for r in s.restore().collect():
        assert bytes(r.content) == open(r.path, "rb").read()
    refs = s.table("recipes").count()
    assert s.table("chunks").agg(F.sum("refcount")).first()[0] == refs
    overlap = s.table("chunks").alias("a").join(s.table("chunks").alias("b"), F.expr("a.container_id = b.container_id and a.digest < b.digest and a.container_offset < b.container_offset + b.size and b.container_offset < a.container_offset + a.size"))
    assert overlap.count() == 0
    s.ingest(S.read_files(spark, tree), "two")
    assert s.table("chunks").agg(F.sum("refcount")).first()[0] == 2 * refs
    s.delete(F.col("path").endswith("_under.txt"))
    chunks, size = s.collect()
    assert chunks > 0 and size > 0
    assert s.table("chunks").agg(F.sum("refcount")).first()[0] == s.table("recipes").count()
    assert s.table("events").count() == 1
    reset(str(tmp_path / "store"))
    with pytest.raises(ValueError):
        reset(tree)
    with pytest.raises(ValueError):
        Store(spark, tree)


def test_cli_two_passes(spark, tree, tmp_path):
    out = cli.pipeline(spark, tree, tree, str(tmp_path / "s"), str(tmp_path / "o"), SMALL)
    rows = {r.metric: r for r in out.collect()}
    assert rows["files"].first == "5" and rows["files"].second == "10" and rows["files"].delta == "+5"
    assert json.load(open(tmp_path / "o" / "pass1" / "statistics.json"))["write_amplification"] > 0
    assert {r.status: r.files for r in cli.duplicates(spark, tree, str(tmp_path / "d")).collect()} == {"unique": 3, "duplicate": 2}
    assert cli.benchmark(spark, tree, SMALL, 2).count() == 3


def test_stream_into_store(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("p", bytearray(b"z" * 5000)), ("q", bytearray(b"z" * 5000))], "path string, content binary").write.parquet(src)
    s = Store(spark, str(tmp_path / "store"), SMALL)
    stream = spark.readStream.schema("path string, content binary").parquet(src)
    into_store(stream, s, str(tmp_path / "c")).awaitTermination()
    into_store(stream, s, str(tmp_path / "c2")).awaitTermination()  # replayed: nothing counts twice
    assert s.table("files").count() == 2 and s.table("chunks").agg(F.sum("refcount")).first()[0] == s.table("recipes").count()


XML = """<mediawiki><siteinfo/>
<page><title> Alpha </title><ns>0</ns><revision><text>{{a {{b}} c}}%s</text></revision></page>
<page><title>Talk</title><ns>1</ns><revision><text>long</text></revision></page>
<page><title>2024</title><ns>0</ns><revision><text>  #redirect [[Alpha]]</text></revision></page>
<page><title>Bad</title><ns>x</ns><revision><text>long</text></revision></page>
<page><title>Short</title><ns>0</ns><revision><text>short</text></revision></page>
<page><title>Empty</title><ns>0</ns><revision><text></text></revision></page></mediawiki>"""


def test_dump(spark, tmp_path):
    path = tmp_path / "d.xml.bz2"
    path.write_bytes(bz2.compress((XML % ("[[x|label]] word " * 60)).encode()))
    pages = S.read_dump(spark, str(path))
    assert sorted(r.title for r in pages.collect()) == ["Alpha", "Short"]
    kept = S.clean_articles(pages).collect()
    assert [r.title for r in kept] == ["Alpha"] and kept[0].text.startswith("label word") and "{{" not in kept[0].text
    S.write_articles(S.clean_articles(pages), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


@pytest.mark.parametrize("text,want", [("a{{x{{y}}z}}b", "ab"), ("a{{open", "a"), ("a}}b", "a}}b"), ("", ""), ("{{a}}{{b}}", "")])
def test_templates(text, want):
    assert textprep._without_templates(text) == want


def test_rank_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double").withColumn("g", F.lit(1))
    assert cost.rank_percentiles(df, "v", (0.5, 0.95), ["g"]).first()[1:] == (5.0, 9.0)
    assert tuple(cost.percentiles_by_rank(df.withColumn("v", F.col("v") - 4), "v", (0.0, 0.5, 0.95)).first()) == (-4.0, 1.0, 5.0)


def test_risks_and_periods():
    p_hot = (1 + 513) / (2 + 894_855)
    assert cost.choose_strategy(5213, p_hot, 130305, 0.00001) == "hot_first"
    assert round(5213 + (1 - p_hot) * 130305) == 135443
    assert wholefile.merge_periods(1000, 500, 13)[:7] == [1000, 1000, 1000, 1000, 1000, 900, 810] and wholefile.merge_periods(1000, 500, 20)[-1] == 500


def test_sightings(spark):
    f = spark.createDataFrame([(i, "h", 1) for i in range(6)], "path bigint, file_hash string, file_size bigint")
    assert [(r.tier, r.result, r.frequency) for r in wholefile.sightings(f).orderBy("path").collect()] == [("high", "new", 1), ("low", "new", 2), ("low", "new", 3), ("medium", "new", 4), ("medium", "duplicate", 4), ("medium", "duplicate", 4)]


def test_histogram_of_one_value(spark):
    assert analysis.histogram(spark.createDataFrame([(3,), (3,)], "v int"), "v", 10).collect() == [(0, 2)]


def test_stable_hash(spark):
    import hashlib

    from chunkwright.functions.hashing import stable_hash

    df = spark.createDataFrame([("abc",), ("",), (None,)], "v string")
    want = [int.from_bytes(hashlib.blake2b(f"7:{v}".encode(), digest_size=8).digest(), "big") % 1009 for v in ("abc", "")]
    assert [r[0] for r in df.select(stable_hash(7, F.col("v"), 1009)).collect()] == [*want, None]
