import os
import random

import pytest
from pyspark.sql import Row, functions as F

from stowage.functions import binary, codec
from stowage.functions.errors import ArchiveError
from stowage.plans import archive
from stowage.sources import format as fmt
from stowage.sources.archive import read_archive

SIZES = {"alpha": 0, "one": 1, "exact": 2**20, "more": 2**20 + 1, "two": 2**21, "noise": 300_000}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    src = root / "src"
    (src / "a" / "deep").mkdir(parents=True)
    rng = random.Random(5)
    for name, size in SIZES.items():
        (src / "a" / name).write_bytes(rng.randbytes(size) if name == "noise" else b"x" * size)
    (src / "a-b").write_text("after a")
    (src / ".hidden").write_text("")
    os.link(src / "a" / "two", src / "hard")
    os.symlink("a/one", src / "soft")
    os.utime(src / "a-b", ns=(-1_500_000_001, -1_500_000_001))
    return root


@pytest.fixture(scope="module", params=[fmt.BLAKE3, fmt.SHA256])
def made(spark, tree, request):
    path = str(tree / f"archive-{request.param}")
    archive.create(spark, path, str(tree / "src"), hash_alg=request.param)
    return path


def tree_of(root):
    out = {}
    for base, dirs, names in os.walk(root):
        for n in dirs + names:
            p = os.path.join(base, n)
            s = os.lstat(p)
            kind = "link" if os.path.islink(p) else "dir" if os.path.isdir(p) else "file"
            data = os.readlink(p) if kind == "link" else open(p, "rb").read() if kind == "file" else b""
            out[os.path.relpath(p, root)] = (kind, data, s.st_mtime_ns, s.st_nlink if kind == "file" else 0)
    return out


def test_round_trip(spark, tree, made, tmp_path):
    archive.verify(spark, made)
    archive.extract(spark, made, str(tmp_path))
    assert tree_of(tmp_path) == tree_of(tree / "src")


def test_order_and_links(made):
    _, members = read_archive(made)
    paths = [m.path for m in members]
    assert paths[:3] == [".hidden", "a", "a/alpha"] and paths.index("a-b") > paths.index("a/two")
    assert next(m for m in members if m.path == "hard").link == "a/two"


def test_two_runs_give_the_same_bytes(spark, tree, made):
    again = made + "-again"
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    archive.create(spark, again, str(tree / "src"), hash_alg=read_archive(made)[0])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert open(again, "rb").read() == open(made, "rb").read()


def test_listing_and_requests(spark, made):
    lines = [r.line for r in archive.listing_of(spark, made, ["soft", "a", "soft"]).collect()]
    assert lines == ["soft", "a", "soft"]
    with pytest.raises(ArchiveError) as e:
        archive.listing_of(spark, made, ["nothing"])
    assert e.value.code == "FMT_INDEX" and e.value.exit == 3


def test_selection_takes_targets_along(spark, made, tmp_path):
    archive.extract(spark, made, str(tmp_path), ["hard"])
    assert sorted(os.listdir(tmp_path)) == ["a", "hard"] and os.listdir(tmp_path / "a") == ["two"]


def test_conflicts_and_overwriting(spark, made, tmp_path):
    (tmp_path / "a-b").write_text("old")
    with pytest.raises(ArchiveError):
        archive.extract(spark, made, str(tmp_path), ["a-b"])
    archive.extract(spark, made, str(tmp_path), ["a-b"], overwrite=True)
    assert (tmp_path / "a-b").read_text() == "after a"
    (tmp_path / "soft").mkdir()
    with pytest.raises(ArchiveError):
        archive.extract(spark, made, str(tmp_path), ["a/one", "soft"], overwrite=True)
    assert not (tmp_path / "a" / "one").exists()


def test_flipped_data(spark, made):
    data = bytearray(open(made, "rb").read())
    data[40] ^= 1
    bad = made + "-bad"
    open(bad, "wb").write(data)
    with pytest.raises(ArchiveError) as e:
        archive.verify(spark, bad)
    assert e.value.code in ("FMT_DATA", "HASH_MEMBER")


def test_flipped_index(made):
    data = bytearray(open(made, "rb").read())
    data[-70] ^= 1
    bad = made + "-index"
    open(bad, "wb").write(data)
    with pytest.raises(ArchiveError) as e:
        read_archive(bad)
    assert e.value.code == "HASH_INDEX" and e.value.exit == 4


def test_truncated_file_breaks_the_layout_first(made):
    bad = made + "-short"
    open(bad, "wb").write(open(made, "rb").read()[:-3])
    with pytest.raises(ArchiveError) as e:
        read_archive(bad)
    assert e.value.code == "FMT_INDEX"


def test_destination_within_a_source(spark, tree):
    with pytest.raises(ArchiveError) as e:
        archive.create(spark, str(tree / "src" / "inside"), str(tree / "src"))
    assert e.value.exit == 1


def test_body_is_not_read_for_members(spark, made):
    plan = archive.members(spark, made).select("path")._jdf.queryExecution().toString()
    assert "stowage_members" in plan and "stowage_chunks" not in plan
    assert archive.chunks(spark, made).filter("path = 'a/more'").count() == 2


EMPTY = fmt.digest(fmt.SHA256, b"")


def member(path, kind=fmt.FILE, **more):
    return fmt.Member(path, kind, hash=more.pop("hash", EMPTY), **more)


def data_member(path, at=16, size=5, **more):
    return member(path, size_original=more.pop("size_original", 10), size_compressed=more.pop("size_compressed", size), data_offset=at, chunk_sizes=more.pop("chunk_sizes", [size]), hash=bytes(32), **more)


REJECTED = {
    "absolute": ([member("/a")], 16, "PATH_ABSOLUTE"),
    "dots": ([member("a/../b")], 16, "PATH_TRAVERSAL"),
    "empty component": ([member("a//b")], 16, "FMT_INDEX"),
    "unknown type": ([member("a", 9)], 16, "FMT_MEMBER_TYPE"),
    "symlink absolute": ([member("a", fmt.SYMLINK, link="/x")], 16, "PATH_ABSOLUTE"),
    "symlink dots": ([member("a", fmt.SYMLINK, link="../x")], 16, "PATH_TRAVERSAL"),
    "target missing": ([member("a", fmt.HARDLINK, link="b")], 16, "FMT_INDEX"),
    "target later": ([member("a", fmt.HARDLINK, link="b"), member("b")], 16, "FMT_INDEX"),
    "twice": ([member("a"), member("a")], 16, "FMT_INDEX"),
    "no folder": ([member("a/b")], 16, "FMT_INDEX"),
    "folder is a file": ([member("a"), member("a/b")], 16, "FMT_INDEX"),
    "sum of chunks": ([data_member("a", size_compressed=6)], 21, "FMT_INDEX"),
    "offset too small": ([data_member("a", at=15)], 20, "FMT_INDEX"),
    "past the body": ([data_member("a", at=17)], 21, "FMT_INDEX"),
    "overlap": ([data_member("a"), data_member("b", at=18)], 23, "FMT_INDEX"),
    "link to a folder": ([member("a", fmt.FOLDER), member("b", fmt.HARDLINK, link="a")], 16, "FMT_INDEX"),
    "gap": ([data_member("a"), data_member("b", at=22)], 27, "FMT_INDEX"),
    "number of chunks": ([data_member("a", chunk_sizes=[2, 3])], 21, "FMT_INDEX"),
    "folder with size": ([member("a", fmt.FOLDER, size_original=1)], 16, "FMT_INDEX"),
    "digest of nothing": ([member("a", fmt.FOLDER, hash=bytes(32))], 16, "HASH_MEMBER"),
    "entry before relation": ([member("a"), member("a"), member("/b")], 16, "PATH_ABSOLUTE"),
    "type before link": ([member("b/c"), member("a", 9)], 16, "FMT_MEMBER_TYPE"),
}


def raw_entry(m):
    import struct

    path, link = m.path.encode(), m.link.encode()
    fixed = fmt.ENTRY.pack(m.type, m.mode, m.uid, m.gid, m.mtime_ns, m.size_original, m.size_compressed, m.data_offset, m.hash, len(path))
    tail = struct.pack("<H", len(link)) + link if m.type in (3, 4) else b""
    return fixed + path + tail + struct.pack(f"<I{len(m.chunk_sizes)}I", len(m.chunk_sizes), *m.chunk_sizes)


@pytest.mark.parametrize("case", REJECTED)
def test_rejections(case):
    members, offset, code = REJECTED[case]
    index = b"".join(map(raw_entry, members))
    with pytest.raises(ArchiveError) as e:
        fmt.read_index(index, len(members), fmt.digest(fmt.SHA256, index), fmt.SHA256, offset)
    assert e.value.code == code


@pytest.mark.parametrize("case", REJECTED)
def test_data_frames_reject_the_same(spark, case):
    from stowage.operators import members as rules

    members, offset, code = REJECTED[case]
    rows = [
        (i, m.type, m.path, m.link, m.size_original, m.size_compressed, m.data_offset, len(m.chunk_sizes), m.chunk_sizes, m.hash) for i, m in enumerate(members)
    ]
    df = spark.createDataFrame(rows, "pos long, type int, path string, link string, size_original long, size_compressed long, data_offset long, chunk_count long, chunk_sizes array<long>, hash binary")
    first = rules.first_error(rules.errors(df, offset, empty_digest=EMPTY)).first()
    assert first.code == code


def test_valid_index_passes():
    members = [member("d", fmt.FOLDER), data_member("d/a"), member("d/h", fmt.HARDLINK, link="d/a"), member("d/s", fmt.SYMLINK, link="./a//"), data_member("e", at=21)]
    index = b"".join(map(fmt.entry, members))
    assert len(fmt.read_index(index, 5, fmt.digest(fmt.SHA256, index), fmt.SHA256, 26)) == 5
    with pytest.raises(ArchiveError):
        fmt.read_index(index + b"x", 5, fmt.digest(fmt.SHA256, index + b"x"), fmt.SHA256, 26)
    with pytest.raises(ArchiveError):
        fmt.read_index(index, 5000, fmt.digest(fmt.SHA256, index), fmt.SHA256, 26)


@pytest.mark.parametrize(("at", "value", "code"), [(0, 0, "FMT_MAGIC"), (5, 2, "FMT_VERSION"), (6, 9, None), (7, 1, "FMT_RESERVED"), (8, 2, "FMT_COMP_ALG"), (9, 3, "FMT_HASH_ALG"), (15, 1, "FMT_RESERVED")])
def test_headers(spark, at, value, code):
    from pyspark.sql import functions as F

    from stowage.functions.binary import header_code

    data = bytearray(fmt.header(fmt.SHA256))
    data[at] = value
    row = spark.createDataFrame([(bytes(data),)], "b binary").select(header_code(F.col("b")).alias("c")).first()
    assert row.c == code
    if code is None:
        assert fmt.read_header(bytes(data)) == fmt.SHA256
    else:
        with pytest.raises(ArchiveError) as e:
            fmt.read_header(bytes(data))
        assert e.value.code == code


@pytest.mark.parametrize(("at", "value", "code"), [(52, 0, "FMT_MAGIC"), (55, 0, "FMT_MAGIC"), (56, 1, "FMT_RESERVED"), (63, 9, "FMT_RESERVED"), (40, 7, None)])
def test_footers(spark, at, value, code):
    data = bytearray(fmt.footer(16, 84, bytes(32), 1))
    data[at] = value
    size = 16 + 84 + len(data)
    told = spark.createDataFrame([(bytes(data),), (bytes(data[1:]),)], "data binary").select(binary.footer_code(F.col("data"))).collect()
    assert [r[0] for r in told] == [code, "FMT_TRUNCATED"]
    if code is None:
        assert fmt.read_footer(bytes(data), size)[:2] == (16, 84)
    else:
        with pytest.raises(ArchiveError) as e:
            fmt.read_footer(bytes(data), size)
        assert e.value.code == code


def test_failed_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    from stowage.sources import archive as writer

    rows = [Row(pos=0, chunk_index=0, type=1, mode=0o644, uid=0, gid=0, mtime_ns=0, size_original=3, path="a", link="", data=codec.encode(b"abc"))]
    made = writer.ArchiveWriter({"path": str(tmp_path / "x.arc")})
    done = made.write(iter(rows))

    def broken(*args):
        raise OSError("no space left")

    monkeypatch.setattr(writer, "write_index", broken)
    with pytest.raises(OSError, match="no space"):
        made.commit([done, None])
    assert os.listdir(tmp_path) == []


def test_long_form_is_damage(spark, tmp_path):
    from tests.test_functions import _fixed_block

    stream = _fixed_block([97, "long", "end"])
    path = str(tmp_path / "long.arc")
    rows = [(0, 0, 1, 0o644, 0, 0, 0, 259, "a", "", stream)]
    kinds = "pos long, chunk_index long, type int, mode long, uid long, gid long, mtime_ns long, size_original long, path string, link string, data binary"
    archive.members(spark, path)
    spark.createDataFrame(rows, kinds).coalesce(1).write.format("stowage_archive").mode("append").option("path", path).save()
    for act in (lambda: archive.verify(spark, path), lambda: archive.extract(spark, path, str(tmp_path / "out"))):
        with pytest.raises(ArchiveError) as e:
            act()
        assert e.value.code == "FMT_DATA" and e.value.exit == 3


def test_codes_come_back_from_tasks(spark, tree, tmp_path, monkeypatch):
    src = tmp_path / "src"
    src.mkdir()
    (src / "f").write_bytes(b"abc")
    real = archive.entries
    monkeypatch.setattr(archive, "entries", lambda *a: real(*a).withColumn("mtime_ns", F.col("mtime_ns") + 1))
    with pytest.raises(ArchiveError) as e:
        archive.create(spark, str(tmp_path / "x.arc"), str(src))
    assert e.value.code == "MODIFIED" and e.value.exit == 6 and e.value.path == str(src / "f")
    assert sorted(os.listdir(tmp_path)) == ["src"]


def test_all_modified_files_are_named(spark, tmp_path, monkeypatch):
    src = tmp_path / "src"
    (src / "b").mkdir(parents=True)
    for name in ("a", "b/c", "d", "e"):
        (src / name).write_bytes(b"abc")
    real = archive.entries
    older = F.col("mtime_ns") + F.col("member_path").isin("a", "b/c", "e").cast("long")
    monkeypatch.setattr(archive, "entries", lambda *a: real(*a).withColumn("mtime_ns", older))
    with pytest.raises(ArchiveError) as e:
        archive.create(spark, str(tmp_path / "x.arc"), str(src))
    assert e.value.code == "MODIFIED" and e.value.paths == tuple(str(src / n) for n in ("a", "b/c", "e"))
    assert sorted(os.listdir(tmp_path)) == ["src"]


def test_special_files_are_left_out(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "f").write_bytes(b"abc")
    os.mkfifo(src / "pipe")
    path = str(tmp_path / "x.arc")
    archive.create(spark, path, str(src))
    assert [m.path for m in read_archive(path)[1]] == ["f"]


def test_writer_warns_of_what_it_leaves_out(tmp_path, capsys):
    from stowage.sources import archive as writer

    common = dict(chunk_index=0, type=1, mode=0o644, uid=0, gid=0, mtime_ns=0, size_original=0, link="", data=None, modified=None)
    made = writer.ArchiveWriter({"path": str(tmp_path / "x.arc")})
    rows = [Row(pos=0, path="pipe", skipped="/src/pipe", **common), Row(pos=1, path="f", skipped=None, **common)]
    made.commit([made.write(iter(rows)), made.write(iter([Row(pos=2, path="z", skipped="/src/z", **common)])), None])
    told = capsys.readouterr().err.splitlines()
    assert [line.rpartition(": ")[2] for line in told] == ["/src/pipe", "/src/z"]
    assert [m.path for m in read_archive(str(tmp_path / "x.arc"))[1]] == ["f"] and os.listdir(tmp_path) == ["x.arc"]


def test_walk_of_deep_folders_and_other_devices(tmp_path):
    from stowage.sources.tree import walk

    root, deep = str(tmp_path), tmp_path / "d"
    for _ in range(1500):
        deep.mkdir()
        deep = deep / "d"
    device = os.lstat(root).st_dev
    rows = list(walk(root, os.path.join(root, "d"), "d", device))
    assert [r[2] for r in rows] == ["/".join("d" * n) for n in range(1, 1501)] and {r[3] for r in rows} == {"dir"}
    other = list(walk(root, os.path.join(root, "d"), "d", device + 1))
    assert [(r[2], r[3]) for r in other] == [("d", "mount")]


def test_folders_above_are_looked_at_first(spark, made, tmp_path):
    (tmp_path / "a").write_text("no folder")
    (tmp_path / "a-b").write_text("old")
    with pytest.raises(ArchiveError) as e:
        archive.extract(spark, made, str(tmp_path), ["a/one", "a-b"])
    assert e.value.paths == ("a-b", "a") and sorted(os.listdir(tmp_path)) == ["a", "a-b"]
