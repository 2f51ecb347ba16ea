"""N-gram Jaccard join with a prefix tree, exact for every pair of documents.

1. Every text becomes its set of hashed n-gram shingles.  Equal sets form one
   class; only classes are compared, and the results are spread to the copies.
2. Document frequencies of all shingles are counted exactly in token ranges.
   Shingles move as sorted, delta-coded blocks of whole batches.  A document
   with so many shingles of its own that no partner can reach the threshold is
   done; in ordinary text these are nearly all.  Shingles found hot in a first
   pass (at most ``most_hot``) are known to be shared and take no part in the
   counting, so no range holds a third of all documents.
3. The global order is rarest first.  Two sets that reach the threshold share
   a shingle of their prefixes in this order; documents that share one are
   connected, and the connected groups are joined exactly.
4. In a group the sets form a trie, ordered by frequency in the group, so that
   common parts are common paths.  A traversal carries the overlaps of the path
   with all sets of the group, a subtree inherits them, and sets (or whole
   subtrees) are pruned when the remaining lengths can't reach the threshold.
   Groups above ``block`` sets are split by hash into pairs of blocks, so no
   task holds more than two blocks; only counts and spanning edges leave it.

Edge cases: null and empty texts and texts without words have an empty set and
link with nothing; shorter texts than a shingle count as one shingle of their
whole sequence; equal texts and repeated rows link with each other as other
documents; very long texts are never cut; an empty table gives an empty table;
further columns are ignored.  Shingles are compared by 64-bit hashes of which
48 bits are kept in the blocks: for two sets of 600 a false match has a chance of about 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .components import components
from .runtime import drop_materialised, give_back, lean, lean_group, materialise, prepare

TOKEN_BITS = 48
#: Rows whose shingles a worker holds at once; their numbers take 16 bits in the blocks.
MOST_ROWS = 1 << 12
#: Bytes of text whose shingles a worker holds at once.
MOST_BYTES = 1 << 23
#: Bytes of text whose words a worker holds at once.
BLOCK_BYTES = 1 << 18


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of a block, sorted by both."""
    s, e, doc = tb.words(data, at)
    h = tb.hashes(data, s, e, tb.LOWER)
    size = np.bincount(doc, minlength=len(at) - 1)
    g, first = tb.grams(h, doc, n)
    owner = doc[first]
    for k in range(1, n):
        short, where = tb.grams(h, doc, k)
        ok = size[doc[where]] == k
        g = np.concatenate([g, tb.mix(short[ok] + tb.U(k))])
        owner = np.concatenate([owner, doc[where][ok]])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])]) if len(g) else np.empty(0, bool)
    return owner[new], g[new]


def _batch_sets(batch: pa.RecordBatch, text: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of all shingles of a batch, then size and class key of each row."""
    rows, found, sizes, keys = [np.empty(0, np.int32)], [np.empty(0, tb.U)], [np.empty(0, np.int64)], [np.empty(0, tb.U)]
    for i, j, data, at in tb.blocks(batch.column(text), BLOCK_BYTES):
        owner, g = shingle_sets(data, at, n)
        size = np.bincount(owner, minlength=j - i)
        total = np.concatenate([np.zeros(1, tb.U), np.cumsum(tb.mix(g ^ tb.U(0x5851F42D4C957F2D)))])
        cut = np.concatenate([[0], np.cumsum(size)])
        rows.append((owner + i).astype(np.int32))
        found.append(g)
        sizes.append(size)
        keys.append(tb.mix((total[cut[1:]] - total[cut[:-1]]) ^ size.astype(tb.U)))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(sizes), np.concatenate(keys)


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``MOST_ROWS`` rows and about ``MOST_BYTES`` of text; a longer text stands alone."""
    _, at = tb.buffers(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = min(i + MOST_ROWS, max(i + 1, int(np.searchsorted(at, at[i] + MOST_BYTES, "right")) - 1))
        yield batch.slice(i, j - i)
        i = j


def _planes(values: np.ndarray, width: int) -> bytes:
    """Low ``width`` bytes of each value, byte by byte, so that zero bytes lie together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def _first_pass(docs: DataFrame, text: str, n: int) -> DataFrame:
    """Rows (kind 0: doc_id, version, size, key) and (kind 1: token, local frequency) of locally frequent shingles."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            give_back()
            for batch in _slices(whole, text):
                row, g, size, key = _batch_sets(batch, text, n)
                _, one = np.unique(key, return_index=True)
                chosen = np.zeros(batch.num_rows, bool)
                chosen[one] = True
                tokens = g[chosen[row]]
                del g, row
                tokens >>= tb.U(64 - TOKEN_BITS)
                tokens.sort()
                start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.empty(0, np.int64)
                count = np.diff(np.append(start, len(tokens)))
                hot = count >= max(16, batch.num_rows // 400)
                m, k = batch.num_rows, int(hot.sum())
                ids, version = (pa.concat_arrays([batch.column(c), pa.nulls(k, batch.column(c).type)]) for c in ("doc_id", "version"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([0, 1], [m, k]), pa.int32()), ids, version, pa.array(np.concatenate([size, count[hot]]), pa.int64()), pa.array(np.concatenate([key.astype(np.int64), tokens[start][hot].astype(np.int64)]))],
                    ["kind", "doc_id", "version", "size", "key"],
                )

    return docs.select("doc_id", F.xxhash64(text).alias("version"), text).mapInArrow(lean(run), f"kind int, doc_id {kind.simpleString()}, version long, size long, key long")


def _blocks_of(docs: DataFrame, text: str, n: int, ranges: int, hot: np.ndarray) -> DataFrame:
    """(place, batch, data): the shingles of each batch by token range; negative places hold its rows and their hot shingles."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        number = TaskContext.get().partitionId() << 24
        edges = (np.arange(ranges + 1, dtype=object) * (1 << TOKEN_BITS) // ranges) * 65536
        edges = np.array([min(x, (1 << 64) - 1) for x in edges], tb.U)
        for whole in batches:
            give_back()
            for batch in _slices(whole, text):
                row, g, size, key = _batch_sets(batch, text, n)
                token = g >> tb.U(64 - TOKEN_BITS)
                common = np.zeros(len(token), bool)
                if len(known):
                    common = known[np.minimum(np.searchsorted(known, token), len(known) - 1)] == token
                token <<= tb.U(16)
                token |= row.astype(tb.U)
                packed = token
                del g, row, token
                own = np.sort(packed[common])
                head = np.array([batch.num_rows, len(own)], "<u8").tobytes() + size.astype("<u8").tobytes() + key.astype("<u8").tobytes() + own.astype("<u8").tobytes()
                rest = packed[~common]
                del packed
                rest.sort()
                cut = np.searchsorted(rest, edges)
                cut[-1] = len(rest)
                place, data = [-1 - ((number >> 24) + (number & 0xFFFFFF) * 7919) % (1 << 20)], [head]
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    x = rest[cut[p] : cut[p + 1]]
                    t = x >> tb.U(16)
                    place.append(p)
                    data.append(np.array([len(x)], "<u8").tobytes() + _planes(np.diff(t, prepend=tb.U(0)), 6) + _planes(x & tb.U(0xFFFF), 2))
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array([number] * len(place), pa.int64()), pa.array(data, pa.binary())], ["place", "batch", "data"])
                number += 1

    return docs.select("doc_id", text).mapInArrow(lean(run), "place int, batch long, data binary")


def _count_range(rows: pd.DataFrame) -> pd.DataFrame:
    """Exact document frequencies in one token range; sends each batch its shared shingles only."""
    if rows["place"].iloc[0] < 0:
        return rows[["place", "batch", "data"]]
    tokens, row, batch = [], [], []
    for k, raw in enumerate(rows["data"]):
        m = int(np.frombuffer(raw, "<u8", 1)[0])
        tokens.append(np.cumsum(_unplanes(raw[8 : 8 + 6 * m], m, 6)))
        row.append(_unplanes(raw[8 + 6 * m :], m, 2).astype(np.uint16))
        batch.append(np.full(m, k, np.int32))
    t = np.concatenate(tokens)
    del tokens
    order = np.argsort(t, kind="stable")
    t = t[order]
    same = t[1:] == t[:-1]
    shared = np.append(same, False) | np.append(False, same)
    t, at = t[shared], order[shared]
    del order
    df = np.diff(np.append(np.flatnonzero(np.append(True, t[1:] != t[:-1])), len(t))) if len(t) else np.empty(0, np.int64)
    df = np.repeat(df, df)
    row, batch = np.concatenate(row)[at], np.concatenate(batch)[at]
    out = []
    for k, name in enumerate(rows["batch"]):
        mine = batch == k
        m = int(mine.sum())
        if m:
            out.append((name, np.array([m], "<u8").tobytes() + _planes(np.diff(t[mine], prepend=tb.U(0)), 6) + _planes(row[mine], 2) + _planes(df[mine], 4)))
    return pd.DataFrame({"place": np.zeros(len(out), np.int32), "batch": np.array([x for x, _ in out], np.int64), "data": [x for _, x in out]})


def _required(n, share: int, whole: int):
    """The least overlap that a set of ``n`` can have with any partner."""
    return -(-share * n // whole)


def _live_rows(share: int, whole: int, hot: np.ndarray, hot_df: np.ndarray):
    """Per batch: the sets that may have a partner, as shared shingles in global order with the length of the prefix."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows["data"][rows["place"] < 0].iloc[0]
        n, m = (int(x) for x in np.frombuffer(head, "<u8", 2))
        numbers = np.frombuffer(head, "<u8", offset=16)
        size, key, own = numbers[:n].astype(np.int64), numbers[n : 2 * n], numbers[2 * n : 2 * n + m]
        token, row = [own >> tb.U(16)], [(own & tb.U(0xFFFF)).astype(np.int64)]
        rank = [hot_df[np.searchsorted(hot, token[0])] + (1 << 40)]
        for raw in rows["data"][rows["place"] >= 0]:
            k = int(np.frombuffer(raw, "<u8", 1)[0])
            token.append(np.cumsum(_unplanes(raw[8 : 8 + 6 * k], k, 6)))
            row.append(_unplanes(raw[8 + 6 * k : 8 + 8 * k], k, 2).astype(np.int64))
            rank.append(_unplanes(raw[8 + 8 * k :], k, 4).astype(np.int64))
        token, row, rank = np.concatenate(token), np.concatenate(row), np.concatenate(rank)
        shared = np.bincount(row, minlength=n)
        need = _required(size, share, whole)
        live = (size > 0) & (shared >= need)
        keep = live[row]
        token, row, rank = token[keep], row[keep], rank[keep]
        order = np.lexsort((token, rank, row))
        token, row = token[order], row[order]
        cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        _, one = np.unique(key, return_index=True)
        chosen = [i for i in one.tolist() if live[i]]
        return pd.DataFrame(
            {
                "key": key[chosen].astype(np.int64),
                "size": size[chosen],
                "prefix": (shared - need + 1)[chosen],
                "tokens": [token[cut[i] : cut[i + 1]].astype("<u8").tobytes() for i in chosen],
            }
        )

    return run


def trie_join(sets: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, share: int, whole: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those j) for i in ``left`` and j in ``right`` (flags) with Jaccard of at least share / whole.

    ``sets`` are the shared elements, ``sizes`` the full sizes; an element that
    only one set has can't add to an overlap.  Needs every set once; i itself is left out.
    """
    m = len(sets)
    flat = np.concatenate(sets) if m else np.empty(0, tb.U)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -df))] = np.arange(len(values))
    code = rank[inverse]
    frequency = np.empty(len(values), np.int64)
    frequency[rank] = df
    order = np.lexsort((owner, code))
    holders = owner[order]
    at = np.concatenate([[0], np.cumsum(frequency)])
    forward = np.lexsort((code, owner))
    paths = np.split(code[forward], np.cumsum(np.bincount(owner, minlength=m))[:-1]) if m else []
    length = np.array([len(p) for p in paths])
    todo = sorted(np.flatnonzero(left).tolist(), key=lambda i: tuple(paths[i].tolist()))

    def extend(overlap: np.ndarray, codes: np.ndarray) -> np.ndarray:
        many = frequency[codes]
        ends = np.cumsum(many)
        spots = np.repeat(at[codes] - (ends - many), many) + np.arange(int(ends[-1]))
        return overlap + np.bincount(holders[spots], minlength=m)

    def walk(a: int, b: int, depth: int, overlap: np.ndarray, alive: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The sets todo[a:b] share their first ``depth`` elements; ``alive`` are the partners not yet ruled out."""
        stack = [(a, b, depth, overlap, alive)]
        while stack:
            a, b, depth, overlap, alive = stack.pop()
            first, last = paths[todo[a]], paths[todo[b - 1]]
            k = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:k] != last[depth:k])
            end = depth + (int(differ[0]) if len(differ) else k - depth)
            if end > depth:
                overlap = extend(overlap, first[depth:end])
            # Remaining lengths: the longest continuation in the subtree, and the smallest set in it.
            group = todo[a:b]
            rest = max(length[i] for i in group) - end
            least = min(int(sizes[i]) for i in group)
            most = overlap[alive] + np.minimum(rest, length[alive] - overlap[alive])
            need = -(-share * (least + sizes[alive]) // (share + whole))
            alive = alive[most >= need]
            if not len(alive):
                continue
            while a < b and len(paths[todo[a]]) == end:
                i = todo[a]
                hit = alive[(whole * overlap[alive] >= share * (sizes[i] + sizes[alive] - overlap[alive])) & (alive != i)]
                if len(hit):
                    yield i, hit
                a += 1
            while a < b:
                c, d = paths[todo[a]][end], a + 1
                while d < b and paths[todo[d]][end] == c:
                    d += 1
                stack.append((a, d, end, overlap, alive))
                a = d

    if todo:
        yield from walk(0, len(todo), 0, np.zeros(m, np.int64), np.flatnonzero(right))


def _join_group(share: int, whole: int):
    """Links of one block pair of a group: summed weights of the partners, and a spanning edge for each set."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("key").sort_values("key").reset_index(drop=True)
        keys, sizes, weight = rows["key"].to_numpy(), rows["size"].to_numpy(), rows["copies"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in rows["tokens"]]
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        left, right = (rows["part"] == i).to_numpy(), (rows["part"] == j).to_numpy()
        links, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for x, hit in trie_join(sets, sizes, left, right, share, whole):
            links[x] += weight[hit].sum()
            if i != j:
                links[hit] += weight[x]
            met = np.unique(np.append(label[hit], label[x]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
        found = np.flatnonzero(links)
        return pd.DataFrame({"key": keys[found], "links": links[found], "root": keys[label[found]]})

    return run


def similar(docs: DataFrame, n: int = 3, share: int = 70, whole: int = 100, text: str = "text", most_hot: int = 200_000, block: int = 2000, range_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, version, n_shingles, n_similar, component_id, group) of every row.

    ``version`` is xxhash64 of the text; ``group`` tells components apart whose
    smallest ids are equal, as with repeated or missing ids.  Sets link when whole * intersection >= share * union.
    """
    spark = docs.sparkSession
    prepare(spark)
    first = materialise(_first_pass(docs, text, n))
    rows = first.where("kind = 0").select("doc_id", "version", F.col("size").alias("n_shingles"), "key")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    # Bounded by most_hot; only the order of shingles depends on it, never a result.
    hot_rows = first.where("kind = 1").groupBy("key").agg(F.sum("size").alias("df")).where(F.col("df") >= max(64, count // 2000)).orderBy(F.desc("df"), "key").limit(most_hot).collect()
    hot_rows.sort(key=lambda r: r.key)
    hot = np.array([r.key for r in hot_rows], np.uint64)
    hot_df = np.array([r.df for r in hot_rows], np.int64)

    ranges = max(1, total // range_rows)
    counted = _blocks_of(docs, text, n, ranges, hot).groupBy("place").applyInPandas(lean_group(_count_range), "place int, batch long, data binary")
    live = materialise(counted.groupBy("batch").applyInPandas(lean_group(_live_rows(share, whole, hot, hot_df)), "key long, size long, prefix long, tokens binary"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, k = batch.column("key").to_numpy(), batch.column("prefix").to_numpy()
            parts = [np.frombuffer(x, "<i8")[:p] for x, p in zip(batch.column("tokens").to_pylist(), k.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, [len(p) for p in parts])), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64))], ["key", "token"])

    pairs = live.select("key", "prefix", "tokens").mapInArrow(lean(prefixes), "key long, token long").distinct()
    pairs = materialise(pairs)
    least = pairs.groupBy("token").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least != most").select("token", "least")
    groups = materialise(components(pairs.join(least, "token").where("key != least").select("key", "least").distinct(), "key", "least"))

    classes = materialise(rows.where("n_shingles > 0").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id")))
    parts = groups.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    sets = groups.join(parts, "root").join(live.drop("prefix").dropDuplicates(["key"]).withColumnRenamed("key", "id"), "id").join(classes.select(F.col("key").alias("id"), "copies"), "id")
    sets = sets.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sets = sets.select(F.col("id").alias("key"), "root", "size", "copies", "tokens", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    found = materialise(sets.groupBy("root", "i", "j").applyInPandas(_join_group(share, whole), "key long, links long, root long"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select("key", "root"), "key", "root").withColumnsRenamed({"id": "key"})

    joined = classes.join(links, "key", "left").join(roots, "key", "left").where("copies > 1 or links is not null")
    joined = materialise(joined.withColumn("root", F.coalesce("root", "key")))
    names = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    joined = joined.join(names, "root").select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), "component_id", "copies", F.col("root").alias("group"))
    joined = materialise(joined)
    for done in (live, pairs, groups, classes, found):
        drop_materialised(done)
    # Classes of at least count / 20,000 rows are at most 20,000: a proven bound for the broadcast.
    hot_at = max(1000, count // 20_000)
    big = F.broadcast(joined.where(F.col("copies") >= hot_at)).alias("big")
    out = rows.join(big, "key", "left").withColumnsRenamed({"n_similar": "_n", "component_id": "_c", "group": "_g"}).drop("copies")
    small = joined.where(F.col("copies") < hot_at).drop("copies")
    # Empty sets and rows that the broadcast has served get a key of their own, so that they don't meet in one task.
    out = out.withColumn("key", F.when(F.col("_n").isNull() & (F.col("n_shingles") > 0), F.col("key")).otherwise(F.xxhash64("doc_id", "key"))).join(small, "key", "left")
    served = F.col("_n").isNotNull()
    return out.select("doc_id", "version", "n_shingles", F.when(served, F.col("_n")).otherwise(F.coalesce("n_similar", F.lit(0))).cast("long").alias("n_similar"), F.when(served, F.col("_c")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce("_g", "group", F.xxhash64("doc_id", "version")).alias("group"))


def one_of_each(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without all but one document (the smallest id, then version) of each group that ``similar`` found.

    Repeated rows with equal id and text are one document, of which one row stays; a row without an id stands for a group only if all its rows have none.
    """
    found = materialise(found.select("doc_id", "version", "group"))
    # Documents with equal ids and texts are the only repetition left after the choice.
    again = found.groupBy("doc_id", "version").count().where("count > 1").limit(1).count()
    kept = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "version")).alias("k")).select(F.col("k.doc_id").alias("d"), F.col("k.version").alias("v"))
    # The columns travel in a struct, so that no name of theirs can clash.
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d0"), F.xxhash64(text).alias("v0"))
    out = packed.join(kept, F.col("d0").eqNullSafe(F.col("d")) & (F.col("v0") == F.col("v")), "left_semi")
    if again:
        out = out.dropDuplicates(["d0", "v0"])
    return out.select("row.*")
