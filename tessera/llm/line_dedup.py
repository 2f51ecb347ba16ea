"""Line dedup: pairwise alignment of overlapping documents.

1. A narrow pass gives the hashes of all lines of every document (trimmed of
   blanks; 0 for blank lines), how many words they have, and a unit for each
   line that is not blank: the hash of the least run of whole lines from it on with at
   least ``min_words`` words.  A longer line is its own unit; short lines count
   together with those after them, so passages of short lines are found too.
2. Overlapping documents are found through shared units.  The first document
   with a unit (smallest id) owns it, and a later one with it is paired with
   that owner: a unit that n documents share proposes n - 1 pairs, not n * n,
   and none is left out.  Rare units, held by at most ``rare`` documents,
   propose first.  A frequent unit proposes a pair only for documents in which
   no alignment of a rare pair has covered it.
3. Each pair is aligned by patience diff over all lines of both: common head
   and tail, then lines that are unique in both, their longest increasing
   subsequence as anchors, and the same again between the anchors.
4. Aligned neighbours form blocks (blank lines between them belong to them).
   A block with ``min_words`` words or more is deleted from the later document.
   Lines that stand in another order than the owner's are aligned again, until
   a turn finds no further block.

A document whose whole text an earlier one has, with a unit in it, is an exact
copy: all its lines go, without an alignment.

Lines travel once for each pair they take part in.  An owner's lines are sent
to each of the groups of its pairs; owners with more than 1/20,000 of all pairs
are split into groups by hash, so no task holds a hot owner's pairs.

Edge cases: null and empty texts have no lines and stay as they are; a null id
is kept and never compared; repeated rows (equal id and text) are one document
and lose the same lines; rows that share an id but not the text are ordered by
the hash of the text; texts with fewer than ``min_words`` words have no unit
and stay; very long texts are read whole; an empty table gives an empty table;
further columns are kept, those named like a result column (``n_lines``,
``n_deleted``, ``deleted``) are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .runtime import drop_materialised, lean, materialise, prepare, widened


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        mine, theirs = Counter(a[i:m]), Counter(b[j:n])
        place = {b[k]: k for k in range(j, n) if theirs[b[k]] == 1}
        unique = [k for k in range(i, m) if mine[a[k]] == 1 and a[k] in place]
        anchors = [(unique[k], place[a[unique[k]]]) for k in increasing([place[a[k]] for k in unique])]
        low, low_there = i, j
        for x, y in anchors:
            out.append((x, y))
            todo.append((low, x, low_there, y))
            low, low_there = x + 1, y + 1
        if anchors:
            todo.append((low, m, low_there, n))
    return sorted(out)


def deleted_lines(own: list[int], words: list[int], theirs: list[int], min_words: int, where: dict[int, list[int]] | None = None) -> set[int]:
    """The places of ``own`` that the blocks aligned with ``theirs`` cover; 0 is a blank line.

    ``where``: the places of each line of ``theirs``, if already at hand.
    """
    if where is None:
        where = places_of(theirs)
    gone: set[int] = set()
    while True:
        # Only lines that both have can be aligned; the rest stays in the numbers of the places.
        a = [i for i, h in enumerate(own) if h and h in where and i not in gone]
        b = sorted(j for h in {own[i] for i in a} for j in where[h])
        pairs = [(a[x], b[y]) for x, y in patience([own[i] for i in a], [theirs[j] for j in b])]
        before = len(gone)
        block: list[int] = []
        last = (-1, -1)
        for i, j in [*pairs, (-1, -1)]:
            joined = block and i > 0 and not any(own[last[0] + 1 : i]) and not any(theirs[last[1] + 1 : j])
            if block and not joined:
                if sum(words[k] for k in block) >= min_words:
                    gone.update(block)
                block = []
            if i >= 0:
                block.extend(range(last[0] + 1, i + 1) if joined else (i,))
                last = (i, j)
        if len(gone) == before:
            return gone


def places_of(lines: list[int]) -> dict[int, list[int]]:
    where: dict[int, list[int]] = {}
    for j, h in enumerate(lines):
        if h:
            where.setdefault(h, []).append(j)
    return where


def _not_zero(h: np.ndarray) -> np.ndarray:
    return np.where(h == 0, tb.U(1), h).view(np.int64)


def lines(data: np.ndarray, at: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of each text, then by line: hash, number of words, unit) of a block; 0 for blank lines and where no unit begins."""
    n = len(at) - 1
    s, e, _ = tb.words(data, at)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    bounds = np.concatenate([[0], np.cumsum(np.diff(breaks[at]) + 1)])
    h, count, unit = np.zeros(bounds[-1], np.int64), np.zeros(bounds[-1], np.int32), np.zeros(bounds[-1], np.int64)
    if len(s):
        doc = np.searchsorted(at, s, "right") - 1
        row = bounds[doc] + breaks[s] - breaks[at[:n][doc]]
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        tail = np.append(head[1:], len(s)) - 1
        h[row[head]] = _not_zero(tb.hashes(data, s[head], e[tail]))
        count[row[head]] = tail - head + 1
        # The line that holds the word that makes a run long enough, in the same text.
        end = np.minimum(head + min_words - 1, len(s) - 1)
        full = (head + min_words - 1 < len(s)) & (doc[end] == doc[head])
        line = np.searchsorted(head, end, "right") - 1
        single = full & (line == np.arange(len(head)))
        unit[row[head[single]]] = h[row[head[single]]]
        run = np.flatnonzero(full & ~single)
        if len(run):
            unit[row[head[run]]] = _not_zero(tb.mix(tb.hashes(data, s[head[run]], e[tail[line[run]]]) + tb.U(7)))
    return bounds, h, count, unit


def all_lines(docs: DataFrame, min_words: int, text: str = "text") -> DataFrame:
    """(doc_id, version, lines, words, units) of every text with a unit; one narrow pass.

    ``units`` are distinct; the last one stands for the whole text.
    """
    prepare(docs.sparkSession)
    rows = docs.where(F.col("doc_id").isNotNull() & (F.length(text) > 0)).select("doc_id", F.xxhash64(text).alias("version"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            version = batch.column("version").to_numpy().view(tb.U)
            for i, j, data, at in tb.blocks(batch.column("_text")):
                bounds, h, count, unit = lines(data, at, min_words)
                cut = pa.array(bounds, pa.int32())
                owner = np.repeat(np.arange(j - i), np.diff(bounds))[unit != 0]
                u = unit[unit != 0]
                order = np.lexsort((u, owner))
                owner, u = owner[order], u[order]
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (u[1:] != u[:-1])]) if len(u) else np.empty(0, bool)
                owner, u = owner[new], u[new]
                have = np.unique(owner)
                whole = tb.mix(version[i:j][have] + tb.U(1)).view(np.int64)
                owner = np.concatenate([owner, have])
                u = np.concatenate([u, whole])[np.argsort(owner, kind="stable")]
                units = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=j - i))]), pa.int32())
                made = pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i), batch.column("version").slice(i, j - i), pa.ListArray.from_arrays(cut, pa.array(h)), pa.ListArray.from_arrays(cut, pa.array(count)),
                        pa.ListArray.from_arrays(units, pa.array(u)),
                    ],
                    ["doc_id", "version", "lines", "words", "units"],
                )
                yield made.take(pa.array(have))

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, version long, lines array<long>, words array<int>, units array<long>")


def _align(min_words: int):
    """Rows of a group, the owner's lines first -> (doc_id, version, places) of each later document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theirs, where = [], {}
        for batch in batches:
            (lines, at), (words, _) = ((batch.column(c).values.to_numpy(), batch.column(c).offsets.to_numpy()) for c in ("lines", "words"))
            later = batch.column("later").to_numpy(zero_copy_only=False)
            found, cut, rows = [], [0], []
            for i in range(batch.num_rows):
                own = lines[at[i] : at[i + 1]].tolist()
                if not later[i]:
                    theirs, where = own, places_of(own)
                    continue
                gone = deleted_lines(own, words[at[i] : at[i + 1]].tolist(), theirs, min_words, where)
                if gone:
                    found.extend(sorted(gone))
                    cut.append(len(found))
                    rows.append(i)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("version").take(take), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(found, pa.int32()))], ["doc_id", "version", "places"])

    return run


def _aligned(pairs: DataFrame, whole: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, version, places) of the pairs (doc_id, version, owner, owner_version); ``whole`` holds each document once."""
    pairs = materialise(pairs)
    # Owners with at least total / 20,000 pairs are at most 20,000: a proven bound for the broadcast.
    group = max(1000, pairs.count() // 20_000)
    owner = ["owner", "owner_version"]
    hot = F.broadcast(pairs.groupBy(*owner).count().where(F.col("count") >= group).select(*owner, F.ceil(F.col("count") / group).cast("int").alias("parts")))
    keyed = pairs.join(hot, owner, "left").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", "version"), F.col("parts")).cast("int")).otherwise(0)).drop("parts")
    columns = [*owner, "part", "later", "doc_id", "version", "lines", "words"]
    members = keyed.join(whole, ["doc_id", "version"]).withColumn("later", F.lit(True)).select(*columns)
    named = whole.withColumnsRenamed({"doc_id": "owner", "version": "owner_version"})
    heads = keyed.select(*owner, "part").distinct().join(named, owner).withColumns({"later": F.lit(False), "doc_id": F.col("owner"), "version": F.col("owner_version")}).select(*columns)
    ordered = heads.unionByName(members).repartition(*owner, "part").sortWithinPartitions(*owner, "part", "later")
    kind = whole.schema["doc_id"].dataType.simpleString()
    return materialise(ordered.select("later", "doc_id", "version", "lines", "words").mapInArrow(lean(_align(min_words)), f"doc_id {kind}, version long, places array<int>"))


def deletions(docs: DataFrame, min_words: int = 8, text: str = "text", rare: int = 1000) -> DataFrame:
    """(doc_id, version, places): the line numbers that each later document loses."""
    whole = materialise(all_lines(docs, min_words, text))
    ids = ["doc_id", "version"]
    rows = whole.select(*ids, F.posexplode("units").alias("k", "h"), F.size("units").alias("n")).select(*ids, "h", (F.col("k") == F.col("n") - 1).alias("copy"))
    # The owner is a minimum, combined before the shuffle; units of one document only drop out.
    owners = rows.groupBy("h").agg(F.min(F.struct(*ids)).alias("o"), F.max(F.struct(*ids)).alias("_last"), F.count("*").alias("df")).where("o != _last")
    owners = materialise(owners.select("h", F.col("o.doc_id").alias("owner"), F.col("o.version").alias("owner_version"), "df"))
    # Units with df >= total / 20,000 are at most 20,000: a proven bound for the broadcast.
    hot_at = max(1000, rows.count() // 20_000)
    hot, cold = owners.where(F.col("df") >= hot_at), owners.where(F.col("df") < hot_at)
    shared = rows.join(F.broadcast(hot), "h").unionByName(rows.join(F.broadcast(hot.select("h")), "h", "left_anti").join(cold, "h"))
    shared = materialise(shared.where((F.col("doc_id") != F.col("owner")) | (F.col("version") != F.col("owner_version"))))
    once = whole.select(*ids, "lines", "words", "units").dropDuplicates(ids)
    copies = shared.where("copy").select(*ids).distinct()
    open_ = materialise(shared.where(~F.col("copy")).join(copies, ids, "left_anti").drop("copy"))
    pair = [*ids, "owner", "owner_version"]
    first = _aligned(open_.where(F.col("df") <= rare).select(*pair).distinct(), once.drop("units"), min_words)
    # Frequent units whose lines no block has covered yet propose pairs now.
    frequent = open_.where(F.col("df") > rare)
    touched = first.groupBy(*ids).agg(F.flatten(F.collect_list("places")).alias("gone"))
    left = frequent.select(*ids).distinct().join(touched, ids).join(once.select(*ids, "lines"), ids)
    covered = left.select(*ids, F.explode(F.array_distinct(F.transform("gone", lambda i: F.get("lines", i)))).alias("h"))
    second = _aligned(frequent.join(covered, [*ids, "h"], "left_anti").select(*pair).distinct(), once.drop("units"), min_words)
    all_of = copies.join(once, ids).select(*ids, F.sequence(F.lit(0), F.size("lines") - 1).alias("places"))
    found = first.unionByName(second).groupBy(*ids).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    lost = materialise(found.unionByName(all_of))
    for done in (owners, shared, open_, first, second):
        drop_materialised(done)
    return lost


def dedup(docs: DataFrame, min_words: int = 8, text: str = "text", rare: int = 1000, filter_bits: int = 26) -> DataFrame:
    """``docs`` with the deleted blocks cut out of ``text``, and ``n_lines``, ``n_deleted`` and ``deleted`` (line numbers).

    Only texts that may lose a line are shuffled to their places: a bit map of
    ``2**filter_bits`` bits (8 MB, whatever the corpus) tells which may.
    """
    spark = docs.sparkSession
    prepare(spark)
    lost = deletions(docs, min_words, text, rare)
    added = {"n_lines": pa.int64(), "n_deleted": pa.int64(), "deleted": pa.list_(pa.int32())}
    base = docs.select(*[c for c in docs.columns if c not in added])
    bit = lambda: F.pmod(F.xxhash64("doc_id", "version"), F.lit(1 << filter_bits)) + 1
    bits = lost.select(bit().alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    # The columns travel in a struct, so that no name of theirs can clash with one of the join's.
    packed = base.select(F.struct(*base.columns).alias("row"), F.col("doc_id"), F.xxhash64(text).alias("version"))
    marked = packed.withColumn("bit", bit()).withColumn("bucket", F.bitmap_bucket_number("bit")).withColumn("at", F.bitmap_bit_position("bit")).join(F.broadcast(bits), "bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.shiftright("at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.expr("doc_id is not null") & (F.getbit(byte, (F.col("at") % 8).cast("int")) == 1), F.lit(False))
    marked = marked.select("row", "doc_id", "version", may.alias("may"))
    breaks = F.length(F.col(f"row.`{text}`")) - F.length(F.translate(F.col(f"row.`{text}`"), "\n", ""))
    n_lines = F.when(F.length(F.col(f"row.`{text}`")) > 0, breaks + 1).otherwise(0).cast("long")
    untouched = marked.where(~F.col("may")).select("row.*", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_deleted"), F.array().cast("array<int>").alias("deleted"))
    joined = marked.where("may").select("row", "doc_id", "version", n_lines.alias("n")).join(lost, ["doc_id", "version"], "left").select("row", "n", "places")
    schema = widened(base.schema, n_lines="long", n_deleted="long", deleted="array<int>")
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.column("row").flatten()))
            places, new = batch.column("places").to_pylist(), []
            for t, n, gone in zip(columns[text].to_pylist(), batch.column("n").to_pylist(), places):
                if gone and len(gone) == n:
                    t = ""
                elif gone:
                    drop = set(gone)
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
                new.append(t)
            columns[text] = pa.array(new, columns[text].type)
            n_deleted = pa.array([len(p) if p else 0 for p in places], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns.values(), batch.column("n"), n_deleted, pa.array([p or [] for p in places], pa.list_(pa.int32()))], [*names, *added])

    return untouched.unionByName(joined.mapInArrow(lean(run), schema))
