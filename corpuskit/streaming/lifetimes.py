"""What a batch of file events, taken in their order, leaves of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuskit.plans.scratch import Scratch


def _instant(events: DataFrame) -> Column:
    """Order of an event: its time, then its number where the source gives one, then the event itself."""
    number = F.col("seq").cast("long") if "seq" in events.columns else F.lit(0).cast("long")
    return F.struct(F.col("ts").alias("ts"), number.alias("seq"), F.col("action").alias("action"), F.col("path").alias("path"), F.col("old_path").alias("old_path"))


def lifetimes(events: DataFrame) -> DataFrame:
    """``(start, born_at, born_path, touched, path, ended)``: one row per file that the events show.

    Events are ``(ts, path, old_path, action)`` with the actions create, modify,
    delete and rename, and may have a ``seq`` that orders equal times; equal
    rows count once. Each path's events cut its time into intervals that one
    file holds: a delete or a rename away ends one, a rename onto the path
    removes its holder and starts one. A file's intervals are linked by its
    renames; links are followed by pointer jumping, in as many joins as the
    logarithm of the longest chain.

    ``start`` is the path at which the file stood before the first event, if one
    did: whoever keeps a table of files knows. It is null for one that came later; ``born_at`` and ``born_path`` the first event that creates,
    changes or moves it in, for a file not known before; ``path`` where it is at
    last, ``ended`` whether it is gone by then. ``touched`` says that its text may
    have changed. A path's events are sorted in one task, on disk if need be.
    """
    scratch = Scratch(events.sparkSession, "lifetimes")
    events = events.where("action <> 'rename' or old_path is null or path <> old_path").select(_instant(events).alias("at"))
    ends = F.when(F.col("at.action") == "rename", F.array("at.path", "at.old_path")).otherwise(F.array("at.path"))
    marks = events.select(F.explode(ends).alias("path"), "at").where("path is not null")
    # One sort by path and time serves all windows. Of a path's marks only cuts and the first touch after each count; equal ones are one.
    order = Window.partitionBy("path").orderBy("at")
    is_touch = lambda at: F.col("path").eqNullSafe(F.col(f"{at}.path")) & ~F.coalesce(F.col(f"{at}.action"), F.lit("")).isin("delete", "rename")
    marks = marks.withColumn("before", F.lag("at").over(order)).withColumn("first", F.col("before").isNull())
    marks = marks.where(F.col("first") | ~(F.col("before").eqNullSafe(F.col("at")) | (is_touch("at") & is_touch("before")))).drop("before").withColumn("cut", ~is_touch("at"))
    marks = marks.withColumn("n", F.sum(F.col("cut").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marks = marks.withColumn("next", F.lead("at").over(order)).withColumn("after", F.lead("at", 2).over(order)).withColumn("cut_next", F.lead("cut").over(order))
    none = F.lit(None).cast(dict(marks.dtypes)["at"])
    row = lambda n, begin, touch, end: F.struct(n.cast("long").alias("n"), begin.alias("begin"), touch.alias("touch"), end.alias("end"))
    from_cut = F.when(F.coalesce("cut_next", F.lit(True)), row(F.col("n"), F.col("at"), none, F.col("next"))).otherwise(row(F.col("n"), F.col("at"), F.col("next"), F.col("after")))
    from_start = F.when(F.col("cut"), row(F.lit(0), none, none, F.col("at"))).otherwise(row(F.lit(0), none, F.col("at"), F.col("next")))
    held = marks.select("path", F.inline(F.array_compact(F.array(F.when(F.col("first"), from_start), F.when(F.col("cut"), from_cut)))))
    arrives = (F.col("begin.action") == "rename") & F.col("begin.path").eqNullSafe(F.col("path"))
    leaves = (F.col("end.action") == "rename") & ~F.coalesce(F.col("end.path") == F.col("path"), F.lit(False))
    arrived = F.when(arrives, F.col("begin"))
    held = held.select(
        F.struct("path", "n").alias("id"), F.when(arrives, F.col("begin.old_path")).alias("from"), arrived.alias("arrived"), F.least("touch", arrived).alias("birth"),
        F.col("touch").isNotNull().alias("touched"), F.when(leaves, F.col("end")).alias("left"), F.col("end").isNotNull().alias("ended"), F.col("begin").isNull().alias("open"),
    )
    held = scratch.table(held, "held")

    comes = held.where("arrived is not null").select("id", "from", F.col("arrived").alias("when"))
    goes = held.where("left is not null").select(F.col("id.path").alias("from"), F.col("left").alias("when"), F.col("id").alias("head"))
    links = scratch.table(comes.join(goes, ["from", "when"]).select("id", "head"), "links0")
    for k in range(1, 64):
        back = links.select(F.col("id").alias("head"), F.col("head").alias("further"))
        links = scratch.table(links.join(back, "head", "left").select("id", F.coalesce("further", "head").alias("head"), F.col("further").isNotNull().alias("moved")), f"links{k}")
        if not links.where("moved").limit(1).count():
            break
        links = links.drop("moved")
    found = held.select("id", "birth", "touched", F.col("left").isNull().alias("last"), "ended", "open").join(links.select("id", "head"), "id", "left").withColumn("head", F.coalesce("head", "id"))
    files = found.groupBy("head").agg(
        F.min(F.when(F.col("birth").isNotNull(), F.struct(F.col("birth").alias("at"), F.col("id.path").alias("path")))).alias("born"),
        F.max("touched").alias("touched"),
        F.max(F.when(F.col("last"), F.struct(F.col("id.path").alias("path"), F.col("ended").alias("ended")))).alias("last"),
        F.max(F.when(F.col("id") == F.col("head"), F.col("open"))).alias("open"),
    )
    files = files.where("open or born is not null")  # else nothing stood there
    return files.select(F.when(F.col("open"), F.col("head.path")).alias("start"), F.col("born.at").alias("born_at"), F.col("born.path").alias("born_path"), "touched", "last.path", "last.ended")
