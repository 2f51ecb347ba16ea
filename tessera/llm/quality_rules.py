"""Quality rules as a short-circuit cascade.

Each rule has a vectorised test over a block of texts.  ``plan`` has executors
run every rule on those texts of a sample that the base rule keeps, measures
its cost (seconds a text, with taking out the survivors) and its selectivity
(share rejected) and orders the rules by rejection per cost, the greedy order
that minimises the expected cost of a conjunction.  ``verdicts`` evaluates them
in this order, each only on the texts that all earlier rules let through.  The verdict is the conjunction, so it does not depend on the order.

Edge cases: a null or empty text has no words, all its counts are 0 and it
fails the base rule; ties and repeated rows are judged one by one; an empty
table gives an empty table; further columns are kept by ``annotate`` unless
their names clash with the result columns, which replace them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .runtime import lean, prepare, widened

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[128:] = True
SHOUT = np.zeros(256, bool)
SHOUT[list(b"!?")] = True

COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean"}


@dataclass
class Block:
    """Whole texts and what the base counts found in them; rules read from it."""

    data: np.ndarray
    at: np.ndarray
    counts: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def n(self) -> int:
        return len(self.at) - 1

    def share(self, table: np.ndarray) -> np.ndarray:
        """Bytes by text for which ``table`` holds."""
        total = np.concatenate([[0], np.cumsum(table[self.data])])
        return (total[self.at[1:]] - total[self.at[:-1]]).astype(np.float64)

    def take(self, keep: np.ndarray) -> "Block":
        size = np.diff(self.at)
        at = np.concatenate([[0], np.cumsum(size[keep])])
        return Block(self.data[np.repeat(keep, size)], at, {k: v[keep] for k, v in self.counts.items()})


def base_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    n = len(at) - 1
    s, e, doc = tb.words(data, at)
    n_words = np.bincount(doc, minlength=n)
    lead = np.concatenate([[0], np.cumsum(tb.LEAD[data] & ~tb.SPACE[data])])
    sym = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    h = tb.hashes(data, s, e)
    g, first = tb.grams(h, doc, 3)
    many, _ = tb.repeated(tb.mix(g ^ (doc[first].astype(np.uint64) * tb.U(0xA24BAED4963EE407))))
    covered = np.zeros(len(s) + 3, bool)
    hit = first[many]
    for k in range(3):
        covered[hit + k] = True
    ls, le, ldoc = tb.spans(data != 10, at)
    first_word = np.searchsorted(s, ls)
    real = first_word < len(s)
    real[real] = s[first_word[real]] < le[real]
    ls, le, ldoc = ls[real], le[real], ldoc[real]
    lh = tb.hashes(data, ls, le)
    _, later = tb.repeated(tb.mix(lh ^ (ldoc.astype(np.uint64) * tb.U(0xA24BAED4963EE407))))
    return {
        "n_words": n_words,
        "word_chars": lead[at[1:]] - lead[at[:-1]],
        "n_symbols": sym[at[1:]] - sym[at[:-1]],
        "n_dup_lines": np.bincount(ldoc[later], minlength=n),
        "n_repeat_words": np.bincount(doc, weights=covered[: len(s)], minlength=n).astype(np.int64),
        "n_lines": np.bincount(ldoc, minlength=n),
    }


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


#: name -> test of a block that is true for the texts it rejects.
RULES: dict[str, Callable[[Block], np.ndarray]] = {
    "symbols": lambda b: 100 * b.counts["n_symbols"] > 8 * b.counts["word_chars"],
    "dup_lines": lambda b: 100 * b.counts["n_dup_lines"] > 50 * np.maximum(b.counts["n_lines"], 1),
    "word_length": lambda b: (b.counts["word_chars"] < 2 * b.counts["n_words"]) | (b.counts["word_chars"] > 20 * b.counts["n_words"]),
    "upper_case": lambda b: b.share(UPPER) > 0.5 * np.maximum(b.share(LETTER), 1),
    "shouting": lambda b: b.share(SHOUT) > 0.1 * np.maximum(b.counts["word_chars"], 1),
    "letters": lambda b: b.share(LETTER) < 0.5 * np.maximum(b.share(~tb.SPACE), 1),
}


def measure(block: Block, rules: dict | None = None) -> dict[str, tuple[float, int]]:
    """rule -> (seconds, texts rejected) on the texts of a block that the base rule keeps, which are those a rule may get.

    The seconds include taking the survivors out for the rule after it.
    """
    rules = RULES if rules is None else rules
    live = block.take(~base_failed(block.counts))
    out = {}
    for name, test in rules.items():
        began = time.perf_counter()
        bad = test(live)
        if bad.any():
            live.take(~bad)
        out[name] = (time.perf_counter() - began, int(bad.sum()))
    return out


def ordered(found: dict[str, tuple[float, int]], n: int) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) by rejection per cost, from sums over ``n`` texts."""
    rows = [(name, seconds / max(n, 1), rejected / max(n, 1)) for name, (seconds, rejected) in found.items()]
    return sorted(rows, key=lambda x: -x[2] / max(x[1], 1e-12))


def plan(docs: DataFrame, text: str = "text", sample: int = 500, rules: dict | None = None) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) in the order to run, measured by the executors on about ``sample`` texts; only sums reach the driver."""
    prepare(docs.sparkSession)
    chosen = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull()).where(F.pmod(F.xxhash64("t"), F.lit(64)) == 0).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = {name: (0.0, 0) for name in (RULES if rules is None else rules)}, 0
        for batch in batches:
            for _, _, data, at in tb.blocks(batch.column("t")):
                block = Block(data, at, base_counts(data, at))
                n += int((~base_failed(block.counts)).sum())
                for name, (seconds, rejected) in measure(block, rules).items():
                    total[name] = (total[name][0] + seconds, total[name][1] + rejected)
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v[0] for v in total.values()]), pa.array([v[1] for v in total.values()]), pa.array([n] * len(total))], ["name", "s", "bad", "n"])

    sums = {r.name: r for r in chosen.mapInArrow(lean(run), "name string, s double, bad long, n long").groupBy("name").agg(F.sum("s").alias("s"), F.sum("bad").alias("bad"), F.sum("n").alias("n")).collect()}
    names = RULES if rules is None else rules
    return ordered({k: (sums[k].s, sums[k].bad) if k in sums else (0.0, 0) for k in names}, next((r.n for r in sums.values()), 0))


def verdicts(block: Block, order: list[str], rules: dict | None = None) -> np.ndarray:
    """True for the texts that the base rule and every rule keep; later rules see survivors only."""
    rules = RULES if rules is None else rules
    kept = ~base_failed(block.counts)
    for name in order:
        if not kept.any():
            break
        alive = np.flatnonzero(kept)
        live = block if len(alive) == block.n else block.take(kept)
        kept[alive[rules[name](live)]] = False
    return kept


def annotate(docs: DataFrame, text: str = "text", sample: int = 500) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept``; one narrow pass over whole texts."""
    prepare(docs.sparkSession)
    order = [name for name, _, _ in plan(docs, text, sample)]
    base = docs.select(*[c for c in docs.columns if c not in COLUMNS])
    schema = widened(base.schema, **COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[dict] = []
            for _, _, data, at in tb.blocks(batch.column(text)):
                b = Block(data, at, base_counts(data, at))
                made.append(b.counts | {"base_failed": base_failed(b.counts), "kept": verdicts(b, order)})
            if not made:
                continue
            cols = {k: np.concatenate([m[k] for m in made]) for k in COLUMNS}
            arrays = [pa.array(v.astype(np.int64) if COLUMNS[k] == "long" else v) for k, v in cols.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *cols])

    return base.mapInArrow(lean(run), schema)
