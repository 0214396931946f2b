"""Operators against worked-out values, and properties that hold for any input."""

from pyspark.sql import functions as F

from quaver.functions import word as W
from quaver.operators import edit, history, lookup, signal, timeline, words
from quaver.operators import tempo as rates
from quaver.sources import files, lyrics, projects


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def song(spark, text):
    return spark.createDataFrame([(1, text)], "song_id long, text string")


def test_lrc(spark):
    source = "[ti:T]\n[00:01.00]ab cd\n[00:05.00]ef\n"
    items = lyrics.lrc_items(song(spark, source))
    assert rows_of(lyrics.lrc_metadata(items), "song_id") == [(1, {"title": "T"})]
    spread = lyrics.spread(lyrics.lrc_lines(items))
    assert [r[2:] for r in rows_of(spread, "word_idx")] == [("ab", 1000), (" ", 2500), ("cd", 3000), ("\n", 4500), ("ef", 5000), ("\n", 14500)]
    assert lyrics.to_lrc(spread).first().text == "[00:01.00]ab cd\n[00:05.00]ef\n"
    repeats = lyrics.lrc_lines(lyrics.lrc_items(song(spark, "[00:01.00][00:05.00]x\np[00:01.00]q\n[bad")))
    assert [(r.t, r.text) for r in repeats.orderBy("t").collect()] == [(1000, "pq"), (5000, "x")]


def test_stamped_lyrics_with_ruby(spark):
    source = song(spark, "[00:01:00]恋[00:01:50]が[00:02:00]\n@Ruby1=恋,こ[00:00:20]い\n@title=x")
    own = lyrics.stamped_words(source)
    assert [r[2:] for r in rows_of(own, "word_idx")] == [("恋", 1000), ("が", 1500), ("\n", 2000)]
    rules = lyrics.ruby_rules(source)
    assert [tuple(r) for r in rules.collect()] == [(1, 1, "恋", 0, None, ["こ", "い"], [0, 200])]
    found = lookup.ruby_for(own, rules).where("texts is not null").first()
    assert (found.reading, found.texts, found.offsets_ms) == ("恋", ["こ", "い"], [0, 200])


def test_json(spark):
    rows = song(spark, '{"metadata":{"TITLE":"a","title":"b"},"words":7}').select(lyrics.from_json(F.col("text")).alias("d"), lyrics.from_json(F.lit("{")).alias("e")).first()
    assert rows.d.words == [] and rows.e.words == [] and rows.e.metadata == {}


def test_timing_state(spark):
    doc = '{"bpmSegments":[{"bpm":120.26,"start":10.6},{"bpm":"x","start":1},{"bpm":-5,"start":-3}]}'
    got = song(spark, doc).select(lyrics.timing_segments(F.col("text")).alias("s")).first().s
    assert [(x.bpm, x.start) for x in got] == [(0.0, 0), (120.3, 11)]


def points(spark, *ts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(ts)], "song_id long, ordinal long, t long")


def tempo(spark, *segs):
    return spark.createDataFrame([(1, i, s, float(b)) for i, (s, b) in enumerate(segs)], "song_id long, ordinal long, start_ms long, bpm double")


def test_asof_and_snap(spark):
    at = lambda t, d: timeline.snapped(points(spark, t), tempo(spark, (0, 120)), d).first().snapped
    assert [at(1030, 8), at(1040, 8), at(1030, 4)] == [1000, 1063, 1000]
    got = lookup.asof_tempo(points(spark, -5, 0, 7, 20), tempo(spark, (0, 60), (0, 90), (10, 0)))
    assert [r.bpm for r in got.orderBy("t").collect()] == [None, 90.0, 90.0, None]
    got = lookup.asof_tempo(points(spark, -5), tempo(spark, (0, 60)), fallback=True)
    assert got.first().bpm == 60.0
    assert timeline.snapped(points(spark, 1030), tempo(spark).limit(0), 8).first().snapped == 1030


def test_nearest_and_neighbours(spark):
    got = lookup.nearest(points(spark, 0, 14, 15, 16, 99), tempo(spark, (10, 1), (20, 1), (20, 2)))
    assert [r.seg_idx for r in got.orderBy("t").collect()] == [0, 0, 0, 1, 1]
    got = lookup.neighbours(points(spark, 10, 15), tempo(spark, (10, 1), (20, 1)))
    assert [(r.prev_start, r.next_start) for r in got.orderBy("t").collect()] == [(None, 20.0), (10.0, 20.0)]


def kinded(spark, *rows):
    return spark.createDataFrame([(1, i, k, t) for i, (k, t) in enumerate(rows)], "song_id long, ordinal long, kind string, t long")


def test_fills(spark):
    got = timeline.fill_punctuation(kinded(spark, ("sung", 100), ("punctuation", None), ("punctuation", None), ("sung", 300), ("punctuation", None)), ["ordinal"])
    assert [r.filled for r in got.orderBy("ordinal").collect()] == [100, 300, 300, 300, None]
    got = timeline.infer_separators(kinded(spark, ("sung", 1000), ("space", None), ("sung", 1501), ("space", 7), ("sung", None), ("sung", 1000), ("newline", None)), ["ordinal"])
    assert [r.inferred for r in got.orderBy("ordinal").collect()] == [1000, 1250, 1501, 7, None, 1000, 1500]
    got = timeline.monotone(points(spark, 1000, 1000, 900), "t", ["ordinal"])
    assert [r.repaired for r in got.orderBy("ordinal").collect()] == [1000, 1000, 1001]


def test_tempo(spark):
    curve = spark.createDataFrame([(1, i, float(i), float(x)) for i, x in enumerate((120, 121, 130, 131))], "song_id long, ordinal long, t_s double, tempo double")
    assert [(r.bpm, r.start_ms) for r in rates.segments(curve).orderBy("seg_idx").collect()] == [(120.5, 0), (130.5, 2000)]
    assert [tuple(r)[1:] for r in rates.bpm_of_ticks(points(spark, 0, 500, 1000)).collect()] == [(3, 120.0, 120.0)]
    assert rates.bpm_of_ticks(points(spark, 5)).first().bpm_median == 0.0
    steady = [(i * 500) for i in range(20)] + [9500 + i * 900 for i in range(1, 20)]
    assert rates.changes(points(spark, *steady)).count() > 0 and rates.changes(points(spark, *steady[:20])).count() == 0


def test_signal(spark):
    rows = spark.createDataFrame([(1, [0.5, -1.0, 0.25, 0.1, 0.9]), (2, [0.0, 0.0]), (3, [])], "song_id long, samples array<float>")
    got = {r.song_id: r.p for r in rows.select("song_id", signal.peaks(F.col("samples"), 2).alias("p")).collect()}
    assert got == {1: [1.0, 0.25], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    loud = spark.createDataFrame([(1, [0.01] * 20 + [1.0] * 20)], "song_id long, samples array<double>")
    cleaned = signal.gated(loud, 20.0, 8, 4).first().cleaned
    assert max(cleaned[:8]) == 0.0 and 0 < cleaned[-1] <= 1.0
    assert signal.gated(loud, 0.0, 8, 4).first().cleaned[0] == 0.01
    assert [r.mix for r in signal.mixed(rows.withColumn("k", F.lit(1)), ["k"]).collect()][0][:2] == [0.5, -1.0]


def test_char_times(spark):
    rows = spark.createDataFrame([(1, 0, " ab", 1.0, 1.6)], "song_id long, word_idx int, word string, start double, end double")
    assert [(r.char_idx, r.t) for r in timeline.char_times(rows).orderBy("char_idx").collect()] == [(0, 1.2), (1, 1.4)]


def test_edits_keep_numbers_dense(spark):
    own = words.from_text(song(spark, "ab c\nd")).withColumn("t", F.lit(5).cast("long"))
    pick = own.where("reading = 'ab'")
    readings = lambda df: [r.reading for r in df.orderBy("word_idx").collect()]
    assert readings(edit.removed(own, pick)) == [" ", "c", "\n", "d", "\n"]
    assert readings(edit.split_characters(own, pick)) == ["a", "b", " ", "c", "\n", "d", "\n"]
    assert readings(edit.split_in_two(own, pick.withColumn("left", F.lit("a")))) == ["a", "b", " ", "c", "\n", "d", "\n"]
    assert readings(edit.pasted(own, pick, before=True)) == ["ab", "ab", " ", "c", "\n", "d", "\n"]
    out = edit.split_characters(own, pick)
    assert [r.word_idx for r in out.orderBy("word_idx").collect()] == list(range(7))
    assert [r.t for r in out.orderBy("word_idx").collect()][:2] == [5, None]


def test_merging_a_selection(spark):
    plain = lambda r, t=None: W.word(F.lit(r), F.lit(t).cast("bigint"))
    ruby = W.with_syllables(F.lit("恋"), F.array(W.syllable(F.lit("こ"), F.lit(5)), W.syllable(F.lit("い"))), True, False)
    songs = {1: [plain("ab", 1), plain(" "), plain("c", 3), plain("\n")], 2: [plain("ab", 1), ruby, plain("c", 3)], 3: [plain("a"), plain("b"), plain("c")], 4: [plain(" "), plain("\n"), plain("c", 3)]}
    rows = None
    for k, ws in songs.items():
        own = spark.range(1).select(F.lit(k).alias("song_id"), F.posexplode(F.array(*ws)).alias("word_idx", "word"))
        rows = own if rows is None else rows.unionByName(own)
    chosen = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 1), (2, 2), (3, 0), (3, 2), (4, 0), (4, 1)], "song_id int, word_idx int")
    got = {}
    for r in edit.merged_selection(rows, chosen).orderBy("song_id", "word_idx").collect():
        got.setdefault(r.song_id, []).append((r.word_idx, r.word.reading, [tuple(s) for s in r.word.syllables], r.word.with_ruby, r.word.auto))
    assert got[1] == [(0, "abc", [("abc", None)], False, True), (1, "\n", [("\n", None)], False, True)]
    assert got[2] == [(0, "ab", [("ab", 1)], False, True), (1, "恋c", [("こ", 5), ("い", None), ("c", 3)], True, False)]
    assert [x[1] for x in got[3]] == ["a", "b", "c"]  # a gap: nothing changes
    assert [x[1] for x in got[4]] == [" ", "c"]
    assert edit.merged_selection(rows.limit(0), chosen).count() == 0


def test_ruby_rules_keep_repeated_words(spark):
    words_ = spark.createDataFrame([(1, 0, "恋", 1500), (1, 0, "恋", 1500), (1, 1, "恋", 3000), (1, 2, "x", 0)], "song_id int, word_idx int, reading string, t long")
    ruby = spark.createDataFrame([(1, 2, "恋", 1000, 2000, ["b"], [0]), (1, 1, "恋", 0, 2000, ["a"], [0]), (1, 3, "恋", 2500, None, ["c"], [0])], "song_id int, idx int, base string, valid_from long, valid_to long, texts array<string>, offsets_ms array<long>")
    got = sorted((r.word_idx, (r.texts or [None])[0]) for r in lookup.ruby_for(words_, ruby).collect())
    assert got == [(0, "a"), (0, "a"), (1, "c"), (2, None)]


def test_projects_are_saved_and_opened(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"createdAt":"t0","version":"0"}', '{"metadata":{"Title":"T"},"words":[]}', '{"audioFilePath":"a","bpmSegments":[{"bpm":120.04,"start":1.6},{"bpm":-1,"start":-3}]}'), (2, None, "{", None)], "song_id long, project string, lyrics string, timing string")
    folder = str(tmp_path / "p")
    projects.save(rows, folder, "1.0", "t1", "secret")
    assert {r.error for r in projects.open_projects(spark, folder).collect()} == {"bad_password"}
    got = {r.song_id: r for r in projects.open_projects(spark, folder, "secret").collect()}
    assert (got[1].project.version, got[1].project.createdAt, got[1].project.updatedAt) == ("1.0", "t0", "t1") and got[2].project.createdAt == "t1"
    assert got[1].metadata == {"title": "T"} and got[2].words == [] and got[1].error is None
    assert got[1].timing.audioMeta is None and [tuple(s) for s in got[1].timing.bpmSegments] == [(0.0, 0), (120.0, 2)]
    projects.save(rows, folder, "1.1", "t2")
    assert {r.project.version for r in projects.open_projects(spark, folder).collect()} == {"1.1"}


def test_present_files(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    assert [r.exists for r in files.present(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()] == [True, False]


def test_undo_predicates(spark):
    log = spark.createDataFrame([(1, 0, False), (1, 1, True), (2, 0, False)], "user_id long, step int, undone boolean")
    assert {r.user_id: (r.undo, r.redo) for r in history.can_undo(log).collect()} == {1: (True, True), 2: (True, False)}
    assert history.can_undo(log.limit(0)).count() == 0


def test_finished_text(spark):
    rows = spark.createDataFrame([(" a b ",), ("x\n",), ("  ",)], "t string").select(edit.finished_text(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == ["ab", "\n", " "]


def test_history(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, v string")
    log = history.changes(old, new, ["k"])
    assert sorted((r.k, r.change) for r in log.collect()) == [(2, "update"), (3, "delete"), (4, "insert")]
    assert rows_of(history.undone(new, log, ["k"]), "k") == rows_of(old, "k")
    assert rows_of(history.redone(old, log, ["k"]), "k") == rows_of(new, "k")


def test_files(spark):
    projects = spark.createDataFrame([(1, '{"v":1}', "{}", None)], "song_id long, project string, lyrics string, timing string")
    assert tuple(files.unpack_projects(files.pack_projects(projects)).first()) == (1, '{"v":1}', "{}", None, None)
    bad = spark.createDataFrame([(1, bytearray(b"x"))], "song_id long, content binary")
    assert files.unpack_projects(bad).first().error == "BadZipFile"
    sound = files.write_wav(spark.createDataFrame([(1, [0.5, -0.5])], "song_id long, samples array<float>"), 8000)
    assert tuple(files.probe_wav(sound).first()) == (1, 1, 8000, 32, 2)
    assert files.probe_wav(bad).first().channels is None
