"""Packing token sequences into windows: minimum bin slack.

A document's ids (and an end id) are cut into full windows and one remainder.
Remainders are packed by their histogram of lengths: the largest length left
opens a window, and a subset-sum dynamic program over bit sets, with the
multiplicity of each length split into powers of two, finds the multiset of
lengths that comes closest to filling it; the counts are read back from the
stored bit sets.  A window pattern is used as often as the histogram allows,
so the work depends on the number of lengths, not of documents.

Pieces are numbered in a written table of lengths and checksums.  Full windows
are sequences already and are not shuffled; the remainders, which are counted,
go by a hash of their number to groups of about ``group_rows`` rows, each packed
by itself, so no task or driver sees an unbounded set, however many rows are
equal or long; a group leaves at most a few windows with a gap.

Edge cases: a null or empty text is one piece holding the end id only; null ids
are kept; repeated rows are packed one by one; very long texts are cut into as
many pieces as they need; an empty table gives an empty table; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .runtime import give_back, lean, lean_group, materialise, prepare


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum comes closest to ``room`` from below."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << length * part & mask
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + part
            at -= length * part
    return used


def patterns(lengths: np.ndarray, window: int) -> list[tuple[dict[int, int], int]]:
    """(multiset of lengths, how many windows get it) until nothing is left."""
    values, n = np.unique(lengths, return_counts=True)
    counts, found = dict(zip(values.tolist(), n.tolist())), []
    while counts:
        seed = max(counts)
        rest = {k: v - (k == seed) for k, v in counts.items() if v > (k == seed)}
        used = fill(rest, window - seed) if seed < window else {}
        used[seed] = used.get(seed, 0) + 1
        times = min(counts[k] // v for k, v in used.items())
        for k, v in used.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
        found.append((used, times))
    return found


def assign(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset in it) of each row."""
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = -lengths[order]
    at = {int(k): int(np.searchsorted(sorted_lengths, -k)) for k in np.unique(lengths)}
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    base = 0
    for used, times in patterns(lengths, window):
        place = 0
        for length in sorted(used, reverse=True):
            k = used[length]
            rows = order[at[length] : at[length] + k * times]
            at[length] += k * times
            sequence[rows] = base + np.repeat(np.arange(times), k)
            offset[rows] = place + length * np.tile(np.arange(k), times)
            place += length * k
        base += times
    return sequence, offset


def pieces(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows and one remainder of each document."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        v = bpe.vocabulary(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, start, length, crc, tokens = [], [], [], [], []
            i = 0
            for block in bpe.text_blocks(batch.column(text)):
                ids, cut = v.encode_block(block)
                raw = ids.astype("<u4").tobytes()
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    n = b - a + 1
                    own = raw[4 * a : 4 * b] + end
                    for s in range(0, n, window):
                        at.append(i)
                        start.append(s)
                        length.append(min(window, n - s))
                        crc.append(zlib.crc32(own[4 * s : 4 * (s + window)]))
                        tokens.append(n)
                    i += 1
            columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            del batch, columns
            give_back()

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, group_rows: int = 100_000, text: str = "text") -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``."""
    cut = materialise(pieces(docs, path, window, end_id, text).withColumn("_number", F.monotonically_increasing_id()))
    kind = cut.schema["doc_id"].dataType.simpleString()
    columns = [c for c in cut.columns if c != "_number"]
    # A full window is a sequence by itself: bit 62 keeps its number apart from those of the groups.
    full = cut.where(F.col("length") == window).select(*columns, F.col("_number").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group_rows))
    keyed = rest.withColumn("_group", F.pmod(F.xxhash64("_number"), F.lit(groups))).drop("_number")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sequence, offset = assign(rows["length"].to_numpy(), window)
        rows["sequence_id"] = (int(rows["_group"].iloc[0]) << 40) + sequence
        rows["offset"] = offset
        return rows.drop(columns="_group")

    packed = keyed.groupBy("_group").applyInPandas(lean_group(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.unionByName(full)


def sequences(docs: DataFrame, packed: DataFrame, path: str, window: int = 1024, end_id: int = 0, text: str = "text") -> DataFrame:
    """The packed ids themselves: (sequence_id, offset, doc_id, ids), for writing; needs unique ids of documents."""
    encoded = bpe.encode(docs.select("doc_id", text), path, text, "_ids")
    joined = packed.join(encoded, "doc_id")
    ids = F.concat("_ids", F.array(F.lit(end_id)))
    return joined.select("sequence_id", "offset", "doc_id", F.slice(ids, (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
