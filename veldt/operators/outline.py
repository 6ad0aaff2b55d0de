"""Outlines of ordered lines: the headings that enclose each line, where sections end, and headings against a confirmed list."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.operators import scan


def paths(df: DataFrame, doc: str, pos: str, level: str, title: str, levels: int = 6) -> DataFrame:
    """``df`` with ``path`` (titles of the headings a line lies under, outermost first) and ``section_end``.

    Lines of a ``doc`` follow one another by ``pos`` (a long, each once); ``level`` is 1 to ``levels`` for headings, anything else for other lines. A heading
    closes all open ones of its level and deeper and stands in its own path. ``section_end`` is the last ``pos`` before a heading that closes it, or of
    the doc; it is null for other lines. The stack of open headings at a line is the last heading of each level that no higher one came
    after, so it is found by scans, and a document of any length is spread.
    """
    rows = df
    for n in range(1, levels + 1):
        heading = F.when(F.col(level) == n, F.struct(F.col(pos).alias("pos"), F.col(title).alias("title")))
        rows = scan.last_known(rows, [doc], pos, pos, heading, f"__h{n}")
    back = rows.withColumn("__back", -F.col(pos))
    for n in range(1, levels + 1):  # backwards: the place of the next heading that closes level n
        back = scan.last_known(back, [doc], "__back", "__back", F.when(F.col(level).between(1, n), F.col(pos)), f"__n{n}", before=True)
    # the line before a closing heading, or the doc's last one
    back = scan.last_known(back, [doc], pos, pos, F.col(pos), "__prev", before=True)
    ends = back.groupBy(doc).agg(F.max(pos).alias("__last"))
    nxt = F.coalesce(*[F.when(F.col(level) == n, F.col(f"__n{n}")) for n in range(1, levels + 1)])
    before = back.where(F.col(level).between(1, levels)).select(doc, F.col(pos).alias("__next"), F.col("__prev").alias("__end"))
    told = scan.meet(back.withColumn("__next", nxt), before, [doc, "__next"])
    told = scan.meet(told, ends, [doc])
    stack, highest = [], F.lit(None).cast("long")
    for n in range(1, levels + 1):
        own = F.col(f"__h{n}")
        stack.append(F.when(own.isNotNull() & (highest.isNull() | (own["pos"] > highest)), F.struct(own["title"].alias("t"))))
        highest = own["pos"] if n == 1 else F.greatest(highest, own["pos"])
    path = F.transform(F.filter(F.array(*stack), lambda x: x.isNotNull()), lambda x: x["t"])
    end = F.when(F.col(level).between(1, levels), F.coalesce("__end", "__last"))
    return told.select(*df.columns, path.alias("path"), end.alias("section_end"))


def in_order(places: list[int]) -> list[bool]:
    """Which of different numbers belong to the longest rising subsequence; of several the one that keeps earlier ones."""
    tails: list[int] = []
    length = [0] * len(places)
    for i in range(len(places) - 1, -1, -1):  # lengths of rising runs that start here, from the back with signs turned
        k = bisect.bisect_left(tails, -places[i])
        tails[k : k + 1] = [-places[i]]
        length[i] = k + 1
    kept, due, last = [False] * len(places), max(length, default=0), None
    for i, p in enumerate(places):
        if due and length[i] == due and (last is None or p > last):
            kept[i], due, last = True, due - 1, p
    return kept


def against(headings: DataFrame, confirmed: DataFrame, doc: str, pos: str, title: str, place: str) -> DataFrame:
    """Rows (doc, title, place, status): each heading of the confirmed list (title, place, both unique) is in_order, out_of_order or missing in each doc.

    The first line with a title counts. As few headings as possible are out of order. A group has no more rows than the list, whatever the doc holds.
    """
    found = headings.groupBy(doc, title).agg(F.min(pos).alias("pos")).join(F.broadcast(confirmed) if confirmed.count() < scan.BROADCAST else confirmed, title)
    docs = headings.select(doc).distinct()
    rows = found.select(F.col(doc).alias("doc"), F.col(title).alias("title"), F.col(place).cast("long").alias("place"), "pos")

    def judge(pdf):
        pdf = pdf.sort_values("pos")
        pdf["status"] = ["in_order" if k else "out_of_order" for k in in_order(pdf["place"].tolist())]
        return pdf[["doc", "title", "place", "status"]]

    schema = T.StructType([rows.schema["doc"], rows.schema["title"], T.StructField("place", T.LongType()), T.StructField("status", T.StringType())])
    judged = rows.groupBy("doc").applyInPandas(judge, schema)
    every = docs.select(F.col(doc).alias("doc")).crossJoin(F.broadcast(confirmed.select(F.col(title).alias("title"), F.col(place).cast("long").alias("place"))))  # the list itself, for each doc
    full = scan.meet(every, judged.drop("place"), ["doc", "title"])
    return full.select(F.col("doc").alias(doc), F.col("title").alias(title), F.col("place").alias(place), F.coalesce("status", F.lit("missing")).alias("status"))
