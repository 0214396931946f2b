"""Versions: changes between tables and between sequences of words, undo and redo, a stack of steps,
bounded histories, recent files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions.sequence import apply_script, edit_script
from quaver.operators.scan import scanned

#: Fixed value: the steps that can be undone.
STEPS = 200


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change (insert, delete, update), before and after: the rows in which new differs."""
    values = [c for c in old.columns if c not in keys]
    pack = lambda df, name: df.select(*keys, F.struct(*values).alias(name))
    both = pack(old, "before").join(pack(new, "after"), keys, "full_outer")
    kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    return both.withColumn("change", kind).where("change is not null").select(*keys, "change", "before", "after")


def undone(new: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """The table before the logged changes."""
    return _applied(new, log, keys, "before", "insert")


def redone(old: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the logged changes."""
    return _applied(old, log, keys, "after", "delete")


def _applied(table: DataFrame, log: DataFrame, keys: list[str], image: str, gone: str) -> DataFrame:
    kept = table.join(log.select(*keys), keys, "left_anti")
    back = log.where(F.col("change") != gone).select(*keys, f"{image}.*")
    return kept.unionByName(back.select(*table.columns))


def newest(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The ``n`` first rows of each group in an order that names every tie."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recent(files: DataFrame, n: int = 5) -> DataFrame:
    """Each user's last ``n`` distinct paths, newest first. files: user_id, path, at, ordinal.

    Openings are reduced to the last of each path before any ranking.
    """
    last = files.groupBy("user_id", "path").agg(F.max(F.struct("at", "ordinal")).alias("last"))
    rows = last.select("user_id", "path", "last.at", "last.ordinal")
    return newest(rows, ["user_id"], [F.desc("at"), F.desc("ordinal")], n)


def can_undo(log: DataFrame) -> DataFrame:
    """user_id, undo, redo: whether there is a step on either side. log: user_id, step, undone."""
    return log.groupBy("user_id").agg(F.bool_or(~F.col("undone")).alias("undo"), F.bool_or("undone").alias("redo"))


# --- sequences ----------------------------------------------------------------------------------


def word_changes(versions: DataFrame) -> DataFrame:
    """song_id, nth, op (delete or insert), old_idx, new_idx, word: the fewest deletions and insertions that
    make the new words of the old ones.

    versions: song_id, old, new (arrays of words, null: none), a row for each song. Words are text; what else
    belongs to them can be part of it (``to_json``). A word that changes is a deletion and an insertion,
    one that is inserted is one row, however many come after it.
    """
    return versions.select("song_id", F.posexplode(edit_script(F.col("old"), F.col("new"))).alias("nth", "e")).select("song_id", "nth", "e.*")


def words_undone(new: DataFrame, log: DataFrame) -> DataFrame:
    """song_id, words before the logged changes; new: song_id, words after them. Songs without changes stay."""
    return _patched(new, log, True)


def words_redone(old: DataFrame, log: DataFrame) -> DataFrame:
    """song_id, words after the logged changes; old: song_id, words before them."""
    return _patched(old, log, False)


def _patched(songs: DataFrame, log: DataFrame, back: bool) -> DataFrame:
    edits = log.groupBy("song_id").agg(F.collect_list(F.struct("op", "old_idx", "new_idx", "word")).alias("edits_"))
    rows = songs.select("song_id", "words").join(edits.withColumnRenamed("song_id", "key_"), F.col("song_id").eqNullSafe(F.col("key_")), "left")
    return rows.select("song_id", F.when(F.col("edits_").isNull(), F.col("words")).otherwise(apply_script(F.col("words"), F.col("edits_"), back)).alias("words"))


# --- a stack of steps ---------------------------------------------------------------------------


def stack(actions: DataFrame, steps: int = STEPS) -> DataFrame:
    """song_id, ordinal, version, n_undo, n_redo after each action: the version that is shown (the ordinal of
    its record, null before any) and how many steps lie on either side.

    actions: song_id, ordinal, action (record, undo, redo, clear) and, if there is such a column, changed: a
    record that changes nothing is no step (but ends what could be redone). A record ends what could be
    redone; of more than ``steps`` steps the oldest are forgotten; clear forgets all, and the first record after it
    is where steps begin. The state of a song is the versions on both stacks, at most ``steps`` each.
    """

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        now, undo, redo = state or (None, (), ())
        song, at, action, changed = row
        if action == "record":
            if now is None:
                now = at
            elif changed:
                undo, now = (*undo, now)[-steps:], at
            redo = ()
        elif action == "undo" and undo:
            undo, now, redo = undo[:-1], undo[-1], (*redo, now)
        elif action == "redo" and redo:
            redo, now, undo = redo[:-1], redo[-1], (*undo, now)
        elif action == "clear":
            now, undo, redo = None, (), ()
        return (now, undo, redo), [(song, at, now, len(undo), len(redo))]

    own = actions if "changed" in actions.columns else actions.withColumn("changed", F.lit(True))
    return scanned(own, ["ordinal"], ["ordinal", "action", "changed"], step, lambda _: [], "song_id long,ordinal long,version long,n_undo int,n_redo int")


def at_step(current: DataFrame, log: DataFrame, keys: list[str], step: int | Column) -> DataFrame:
    """The table as it was after a step, from what it is now and the log of all steps.

    log: keys, step, change, before (a struct of the other columns; as ``changes`` gives it, with a step). Each key's
    row is the one before its first change after the step; a key without such a change is as it is now. ``step`` may
    be a Column of the keys. No state between is built, however many steps lie between.
    """
    values = [c for c in current.columns if c not in keys]
    first = log.where(F.col("step") > step).groupBy(*keys).agg(F.min_by(F.struct("change", "before"), "step").alias("first_"))
    first = first.select(*[F.col(c).alias(f"{c}_key_") for c in keys], "first_.*")
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_key_")) for c in keys])
    kept = current.join(first, on, "left_anti")
    back = first.where("change <> 'insert'").select(*[F.col(f"{c}_key_").alias(c) for c in keys], *[F.col(f"before.{c}").alias(c) for c in values])
    return kept.unionByName(back)
