"""Stored listings: only new files are read, changed objects replaced, failures leave it as it was."""

import json
import os

import pytest
from pyspark.sql import functions as F

from fleetspark.sources import listing, snapshots


def export(folder, name, objects, at):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text("".join(json.dumps({"name": n, "size_bytes": s, "updated_at": f"2024-01-{d:02d}T00:00:00", "created_at": "2024-01-01T00:00:00"}) + "\n" for n, s, d in objects))
    os.utime(path, (at, at))


def held(found):
    return {r["name"]: r["size_bytes"] for r in found.objects().collect()}


@pytest.fixture
def place(spark, tmp_path):
    return listing.Listing(spark, str(tmp_path / "listing")), tmp_path / "exports"


def test_second_refresh_reads_only_new_files(spark, place):
    found, exports = place
    export(exports, "1.json", [("projects/a/x.zip", 1, 1), ("projects/b/y.zip", 2, 1)], 1_700_000_000)
    assert found.refresh_from_exports(str(exports)) == {"added": 2, "changed": 0}
    # An old file that changes its mind without a new time is not read again.
    export(exports, "1.json", [("projects/a/x.zip", 99, 9)], 1_699_999_000)
    export(exports, "2.json", [("projects/a/x.zip", 5, 2), ("projects/c/deep/er/z.tar.gz", 3, 2)], 1_700_001_000)
    assert found.refresh_from_exports(str(exports)) == {"added": 1, "changed": 1}
    assert held(found) == {"projects/a/x.zip": 5, "projects/b/y.zip": 2, "projects/c/deep/er/z.tar.gz": 3}
    options = []
    found.refresh(lambda o: options.append(o) or snapshots.exported_objects(spark, str(exports), o, listing.MODIFIED))
    assert options == [{"modifiedAfter": "2023-11-14T22:29:58", "timeZone": "UTC"}]
    assert {r["depth"]: r["suffix"] for r in listing.described(found.objects()).collect()} == {2: "zip", 4: "gz"}


def test_nothing_new(place):
    found, exports = place
    export(exports, "1.json", [("projects/a/x.zip", 1, 1)], 1_700_000_000)
    found.refresh_from_exports(str(exports))
    before = found.store.latest(), found.store.files("objects")
    assert found.refresh_from_exports(str(exports)) == {"added": 0, "changed": 0}
    assert found.store.files("objects") == before[1] and held(found) == {"projects/a/x.zip": 1}


def test_empty_folder_then_files(place):
    found, exports = place
    exports.mkdir()
    assert found.refresh_from_exports(str(exports)) == {"added": 0, "changed": 0} and held(found) == {} and found.mark() is None
    export(exports, "1.json", [("projects/a/x.zip", 1, 1), ("projects/a/x.zip", 4, 3), ("projects/a/x.zip", 2, 2), ("stray.zip", 1, 1)], 1_700_000_000)
    assert found.refresh_from_exports(str(exports)) == {"added": 1, "changed": 0} and held(found) == {"projects/a/x.zip": 4}


def test_untouched_files_of_the_listing_stay(place, spark):
    found, exports = place
    export(exports, "1.json", [(f"projects/c{i}/x.zip", i, 1) for i in range(100)], 1_700_000_000)
    found.refresh_from_exports(str(exports))
    change = found.store.begin()
    change.replace("objects", found.objects(), ("name",), 5)
    change.commit()
    before = set(found.store.files("objects"))
    export(exports, "2.json", [("projects/c7/x.zip", 700, 2)], 1_700_001_000)
    assert found.refresh_from_exports(str(exports)) == {"added": 0, "changed": 1}
    assert len(before - set(found.store.files("objects"))) == 1 and held(found)["projects/c7/x.zip"] == 700 and len(held(found)) == 100


def test_broken_refresh_changes_nothing(place):
    found, exports = place
    export(exports, "1.json", [("projects/a/x.zip", 1, 1)], 1_700_000_000)
    found.refresh_from_exports(str(exports))
    mark = found.mark()
    broken = lambda o: found.objects().withColumn(listing.MODIFIED, F.raise_error(F.lit("lost")).cast("timestamp_ntz"))
    with pytest.raises(Exception, match="lost"):
        found.refresh(broken)
    assert found.mark() == mark and held(found) == {"projects/a/x.zip": 1}


def test_objects_by_their_own_metadata(spark, tmp_path):
    found = listing.Listing(spark, str(tmp_path / "listing"))
    for name, at in (("projects/a/1.zip", 1_700_000_000), ("projects/b/2", 1_700_000_500)):
        path = tmp_path / "bucket" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 3)
        os.utime(path, (at, at))
    assert found.refresh_from_files(str(tmp_path / "bucket")) == {"added": 2, "changed": 0}
    path = tmp_path / "bucket" / "projects/a/1.zip"
    path.write_bytes(b"longer")
    assert found.refresh_from_files(str(tmp_path / "bucket")) == {"added": 0, "changed": 1}
    assert held(found) == {"projects/a/1.zip": 6, "projects/b/2": 3}
    path.unlink()
    assert found.forget_missing(snapshots.backup_objects(spark, str(tmp_path / "bucket"))) == 1
    assert held(found) == {"projects/b/2": 3}


def test_owner_texts_lie_where_sparks_writer_puts_them(spark, tmp_path):
    from fleetspark.sources import writers

    rows = [("a", "x"), ("a", "yy"), ("a", None), (None, "n"), ("", "empty"), ("b/c=d%e", "é"), ("ü {x}^", "z "), ("t\tab", "1")] + [(f"c-{i}", str(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "slug string, name string")
    writers.write_owner_texts(df, str(tmp_path / "own"), "slug", "name")
    df.repartition("slug").write.partitionBy("slug").text(str(tmp_path / "spark"))

    def sizes(folder):
        return {p.name: sum(f.stat().st_size for f in p.glob("part-*")) for p in folder.iterdir() if p.is_dir()}

    assert sizes(tmp_path / "own") == sizes(tmp_path / "spark") and len(sizes(tmp_path / "own")) == 205
    assert all(len(list(p.iterdir())) == 1 for p in (tmp_path / "own").iterdir())
    # Hadoop's local file system, which starts a process per file, has left no checksum.
    assert not list((tmp_path / "own").rglob(".*.crc"))


def test_no_owner_leaves_an_empty_folder(spark, tmp_path):
    from fleetspark.sources import writers

    writers.write_owner_texts(spark.createDataFrame([], "slug string, name string"), str(tmp_path / "own"), "slug", "name")
    assert list((tmp_path / "own").iterdir()) == []
