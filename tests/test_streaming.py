from stowage.plans import archive
from stowage.streaming import arrivals


def test_archives_arrive_once(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "in").mkdir()
    (tmp_path / "src" / "f").write_text("one")
    archive.create(spark, str(tmp_path / "in" / "a.arc"), str(tmp_path / "src"))
    (tmp_path / "in" / "bad.arc").write_bytes(b"not an archive at all")
    where = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "check")
    arrivals.append_members(spark, *where).awaitTermination()
    (tmp_path / "src" / "g").write_text("two")
    archive.create(spark, str(tmp_path / "in" / "b.arc"), str(tmp_path / "src"))
    arrivals.append_members(spark, *where).awaitTermination()
    table = spark.read.parquet(where[1])
    rows = sorted((r.archive.rsplit("/", 1)[-1], r.path, r.code) for r in table.collect())
    assert rows == [("a.arc", "f", None), ("b.arc", "f", None), ("b.arc", "g", None), ("bad.arc", "", "FMT_MAGIC")]
    assert {r.path: r.archive.rsplit("/", 1)[-1] for r in arrivals.latest(table).collect()} == {"f": "b.arc", "g": "b.arc"}
