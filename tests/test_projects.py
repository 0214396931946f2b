"""Projects as versions: saving over itself, a song of many, by two at a time, and a save that fails."""

import pytest
from pyspark.sql import functions as F

from quaver.sources import projects


def rows(spark, songs):
    return spark.createDataFrame([(k, "{}", f'{{"metadata":{{"title":"{t}"}},"words":[]}}', None) for k, t in songs.items()], projects.SAVED)


def titles(spark, folder, number=None):
    return {r.song_id: (r.metadata["title"], r.project.version) for r in projects.open_projects(spark, folder, number=number).collect()}


def test_a_folder_is_saved_over_itself(spark, tmp_path):
    folder = str(tmp_path / "p")
    with pytest.raises(FileNotFoundError):
        projects.saved(spark, folder)
    assert projects.save(rows(spark, {1: "a", 2: "b", None: "n"}), folder, "1", "t1") == 1
    again = projects.saved(spark, folder).withColumn("lyrics", F.replace("lyrics", F.lit('"b"'), F.lit('"c"')))
    assert projects.save(again, folder, "2", "t2") == 2
    assert titles(spark, folder) == {1: ("a", "2"), 2: ("c", "2"), None: ("n", "2")}
    # One song of many.
    projects.save(projects.saved(spark, folder).where("song_id = 2"), folder, "3", "t3")
    assert titles(spark, folder) == {1: ("a", "2"), 2: ("c", "3"), None: ("n", "2")}
    assert titles(spark, folder, 1) == {1: ("a", "1"), 2: ("b", "1"), None: ("n", "1")}
    assert projects.compact(spark, folder) == 4 and titles(spark, folder) == {1: ("a", "2"), 2: ("c", "3"), None: ("n", "2")}
    projects.save(rows(spark, {5: "e"}), folder, "5", "t5", replace=True)
    assert titles(spark, folder) == {5: ("e", "5")} and len(titles(spark, folder, 3)) == 3


def test_a_save_that_fails_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "p")
    projects.save(rows(spark, {1: "a"}), folder, "1", "t1")
    bad = projects.saved(spark, folder).withColumn("lyrics", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        projects.save(bad, folder, "2", "t2")
    # Files without a manifest: a save that was killed before its commit.
    rows(spark, {1: "lost", 2: "lost"}).write.parquet(f"{folder}/parts/half")
    (tmp_path / "p" / "manifests" / ".draft").write_text('{"par')
    assert titles(spark, folder) == {1: ("a", "1")}
    assert projects.save(rows(spark, {3: "c"}), folder, "3", "t3") == 2
    assert titles(spark, folder) == {1: ("a", "1"), 3: ("c", "3")}


def test_two_savers_at_a_time(spark, tmp_path, monkeypatch):
    """The other one commits between our look and our commit: ours comes after it."""
    folder = str(tmp_path / "p")
    projects.save(rows(spark, {1: "a"}), folder, "1", "t1")
    numbers, done = projects._Store.numbers, []

    def late(self):
        found = numbers(self)
        if not done:
            done.append(projects.save(rows(spark, {1: "other", 2: "other"}), str(tmp_path / "p"), "2", "t2") if not done.append(0) else 0)
        return found

    monkeypatch.setattr(projects._Store, "numbers", late)
    assert projects.save(rows(spark, {1: "ours"}), folder, "3", "t3") == 3
    monkeypatch.undo()
    assert titles(spark, folder) == {1: ("ours", "3"), 2: ("other", "2")}
