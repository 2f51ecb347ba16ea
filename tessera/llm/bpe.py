"""Byte-pair encoding and decoding.

Encoding is exact: an Aho-Corasick automaton gives the longest vocabulary
token at every position of a piece, a backtracking walk joins tokens left to
right, and two neighbours are accepted only if a pair-compatibility table says
that no merge would have crossed their border.  Every position is left at most
once in failure, so a piece takes linear time.  Decoding gathers token bytes
through an offset table.

Splitting a text into pieces is done with array operations over the code
points of a whole block of texts; each distinct piece is encoded once and kept
in a cache of bounded size.  Texts with code points outside the tabulated
ranges are normalised and split by the tokenizers library, then encoded here.

Edge cases: null counts as empty and has no ids; repeated rows are encoded
one by one; very long texts are one block of their own; an empty table gives
an empty table; clashing columns are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textblocks as tb
from .runtime import prepare

MARK = "\uffff"
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SAFE_END = 0x3040
#: A special token stands in the text as this code point plus its number.
_SPECIAL = 0x10FFF0
BLANK, LETTER, NUMBER, OTHER, SPECIAL, UNSAFE = range(6)


@functools.cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point; those outside the tabulated ranges are unsafe."""
    table = np.full(0x110000, UNSAFE, np.uint8)
    for c in [*range(0x0590), *range(0x1E00, 0x2000), *range(0x2000, 0x2C00), *range(0x3000, _SAFE_END)]:
        kind = unicodedata.category(chr(c))
        table[c] = UNSAFE if kind == "Cn" else LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    table[WHITE] = BLANK
    table[_SPECIAL : _SPECIAL + 8] = SPECIAL
    return table


def _contractions(cp: np.ndarray, cls: np.ndarray, starts: np.ndarray, end_of: np.ndarray) -> None:
    """Let an apostrophe that begins a piece take the letters of 's 't 'm 'd 're 've 'll."""
    n = len(cp)
    at = np.flatnonzero(starts & (cp == 39))
    at = at[at + 1 < end_of[at]]
    at = at[cls[at + 1] == LETTER]
    one = np.isin(cp[at + 1], [ord(c) for c in "stmd"])
    room = at + 2 < end_of[at]
    third = cp[np.minimum(at + 2, n - 1)]
    two = ~one & room & (((third == ord("e")) & ((cp[at + 1] == ord("r")) | (cp[at + 1] == ord("v")))) | ((third == ord("l")) & (cp[at + 1] == ord("l"))))
    for hit, size in ((at[one], 2), (at[two], 3)):
        starts[hit + 1] = False
        rest = hit[hit + size < end_of[hit]] + size
        starts[rest[cls[rest] == LETTER]] = True


def split(cp: np.ndarray, at: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text) of the pieces of texts given as code points.

    ``spaced`` keeps blanks and joins a single space to the next piece;
    otherwise blanks are dropped and digits stand alone.
    """
    n = len(cp)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    cls = _classes()[cp]
    first = np.zeros(n + 1, bool)
    first[at] = True
    doc_start, doc_last = first[:n], first[1:]
    end_of = np.repeat(at[1:], np.diff(at))
    change = doc_start.copy()
    change[1:] |= cls[1:] != cls[:-1]
    change |= cls == SPECIAL
    if not spaced:
        starts = change & (cls != BLANK)
        starts |= cls == NUMBER
        _contractions(cp, cls, starts, end_of)
        edge = starts | (cls == BLANK) | doc_start
    else:
        starts = change.copy()
        blank = cls == BLANK
        # The last blank of a run that is followed by something in the same text.
        last = blank.copy()
        last[:-1] &= ~blank[1:]
        last &= ~doc_last
        last[:-1] &= cls[1:] != SPECIAL
        last[-1] = False
        hit = np.flatnonzero(last)
        starts[hit] = True
        starts[hit[cp[hit] == 32] + 1] = False
        _contractions(cp, cls, starts, end_of)
        edge = starts
    s = np.flatnonzero(starts)
    edges = np.append(np.flatnonzero(edge), n)
    e = edges[np.searchsorted(edges, s, "right")]
    return s, e, np.searchsorted(at, s, "right") - 1


class Vocabulary:
    """A BPE vocabulary with its automaton, pair table and byte offsets."""

    def __init__(self, path: str):
        import ahocorasick
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        form = (lambda t: t[: -len(self.suffix)] + MARK if t.endswith(self.suffix) and len(t) > len(self.suffix) else t) if self.suffix else (lambda t: t)
        made = {a + (b) for a, b in merges}
        base = sorted((t for t in vocab if t not in made), key=vocab.get)
        self.rank = {form(t): i for i, t in enumerate(base)}
        self.out = [vocab[t] for t in base]
        self.parts = [(i, i) for i in range(len(base))]
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            whole = form(a + b)
            x, y = self.rank[form(a)], self.rank[form(b)]
            if whole not in self.rank:
                self.rank[whole] = len(self.out)
                self.out.append(vocab[a + b])
                self.parts.append((x, y))
            self.pairs[x, y] = self.rank[whole]
        self.length = [len(t) for t in self.rank]
        self.shorter = [next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), -1) for t in self.rank]
        self.automaton = ahocorasick.Automaton()
        for t, i in self.rank.items():
            self.automaton.add_word(t[::-1], i)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        #: Tokens that their own text is encoded as: merging their parts is what the merges do last.
        self.closed = {t for t, (a, b) in enumerate(self.parts) if a == t or self._whole(t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.number = {t: chr(_SPECIAL + k) for k, t in enumerate(self.special)}
        self.spaced = not self.suffix
        self.lower = self.suffix != ""
        self.library = tokenizers.Tokenizer.from_file(path)
        joined = spec.get("decoder") is None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        back = {c: b for b, c in enumerate(byte_chars())}
        size = max(names) + 1
        text = [names.get(i, "") for i in range(size)]
        raw = [(t + " ").encode() if joined else t.encode() if i in self.special.values() else bytes(back[c] for c in t) for i, t in enumerate(text)]
        self.joined = joined
        self.offset = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.map = "".join(byte_chars())
        self.clear()

    def clear(self) -> None:
        """Forget the cached pieces."""
        self.known: dict[int, int] = {}
        self.keys, self.places = np.empty(0, tb.U), np.empty(0, np.int64)
        self.start = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.seen = np.zeros(1 << 16, np.int32)
        self.used = self.entries = 0

    def forget(self, most: int) -> None:
        """Drop the pieces that one block only had, and the rarer ones beyond ``most``."""
        self._settle()
        often = self.seen[self.places]
        kept = np.flatnonzero(often > 1)
        if len(kept) > most:
            kept = np.sort(kept[np.argsort(-often[kept], kind="stable")[:most]])
        keys, places = self.keys[kept], self.places[kept]
        start, count, flat, seen = self.start[places], self.count[places], self.flat, self.seen[places]
        self.clear()
        ends = np.cumsum(count)
        self.entries, self.used = len(keys), int(ends[-1]) if len(ends) else 0
        self.flat = np.resize(flat[np.repeat(start - (ends - count), count) + np.arange(self.used)], max(self.used, 1 << 18))
        size = max(self.entries, 1 << 16)
        # Counted anew, so that pieces of other texts can take their place.
        self.start, self.count, self.seen = np.resize(ends - count, size), np.resize(count, size), np.resize(seen // 2, size)
        self.keys, self.places = keys, np.arange(self.entries)

    def _settle(self) -> None:
        """Move the recent entries into the sorted arrays, which take a tenth of the memory."""
        keys = np.concatenate([self.keys, np.fromiter(self.known, tb.U, len(self.known))])
        places = np.concatenate([self.places, np.fromiter(self.known.values(), np.int64, len(self.known))])
        order = np.argsort(keys)
        self.keys, self.places, self.known = keys[order], places[order], {}

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is not cached."""
        out = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = self.places[at[hit]]
        if self.known:
            rest = np.flatnonzero(out < 0)
            get = self.known.get
            out[rest] = [get(k, -1) for k in keys[rest].tolist()]
        return out

    def _whole(self, token: int) -> bool:
        """Whether nothing crosses the border of the token's parts earlier than the merge that makes it."""
        a, b = self.parts[token]
        return self.pairs[a, b] == token and self._compatible(a, b, token)

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` is what the merges leave: no merge across the border comes earlier than those inside."""
        key = a << 20 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            found = self.fits[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int, limit: int = 1 << 62) -> bool:
        parts, pairs = self.parts, self.pairs
        while True:
            whole = pairs.get((a, b))
            if whole is not None and whole < limit:
                return False
            if a > b:
                limit = a
                a = parts[a][1]
                if a == limit:
                    limit = b + 1
                    b = parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = parts[a][1]
                    if a == limit:
                        return True

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece written in byte characters."""
        if self.suffix:
            piece += MARK
        whole = self.rank.get(piece)
        if whole is not None and whole in self.closed:
            return [self.out[whole]]
        n = len(piece)
        # The longest match at a place is reported first, so it is written last.
        longest = {n - 1 - end: token for end, token in reversed([*self.automaton.iter(piece[::-1])])}
        ok = bytearray(b"\x01") * (n + 1)
        if self.suffix:
            ok[n - 1] = 0
        tokens: list[int] = []
        pos, length, shorter = 0, self.length, self.shorter
        token = longest[0]
        while True:
            last = tokens[-1] if tokens else -1
            while True:
                end = pos + length[token]
                if ok[end] and (last < 0 or self.compatible(last, token)):
                    tokens.append(token)
                    pos = end
                    if pos == n:
                        return [self.out[t] for t in tokens]
                    token = longest[pos]
                    break
                token = shorter[token]
                if token < 0:
                    ok[pos] = 0
                    token = tokens.pop()
                    pos -= length[token]
                    # The same token is refused now, as its end is closed.
                    break

    def _add(self, key: int, ids: list[int]) -> int:
        place, n = self.entries, len(ids)
        if place >= len(self.start):
            self.start, self.count, self.seen = (np.resize(x, 2 * place) for x in (self.start, self.count, self.seen))
        if self.used + n > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat) + n)
        self.start[place], self.count[place], self.seen[place] = self.used, n, 0
        self.flat[self.used : self.used + n] = ids
        self.used += n
        self.known[key] = place
        self.entries += 1
        return place

    def prepared(self, text: str) -> str:
        """The text as its pieces see it: specials as single code points, then normalised and lower-cased if the vocabulary asks for it."""
        if self.special_pattern is not None and "<|" in text:
            text = "".join(self.number.get(x, x) for x in self.special_pattern.split(text))
        if self.lower:
            if text.isascii():
                return text.lower()
            text = unicodedata.normalize("NFC", text)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return text

    def _by_library(self, text: str) -> list[int]:
        """Ids of a text outside the tabulated code points."""
        ids: list[int] = []
        for part in self.special_pattern.split(text) if self.special_pattern is not None else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                if self.library.normalizer is not None:
                    part = self.library.normalizer.normalize_str(part)
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(part):
                    ids += self.encode_piece(piece)
        return ids

    def encode_block(self, texts: list[str], most_cached: int = 600_000) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets by text)."""
        if self.entries > most_cached:
            self.forget(most_cached // 2)
        elif len(self.known) > 60_000:
            self._settle()
        ready = [self.prepared(t) for t in texts]
        size = np.array([len(t) for t in ready], np.int64)
        cp = np.frombuffer("".join(ready).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate([[0], np.cumsum(size)])
        odd: dict[int, list[int]] = {}
        classes = _classes()
        # A text that holds the stand-ins itself also goes the long way.
        strange = np.flatnonzero(classes[cp] >= SPECIAL)
        if len(strange):
            for i in set((np.searchsorted(at, strange, "right") - 1).tolist()):
                text = texts[i]
                if (classes[cp[at[i] : at[i + 1]]] == UNSAFE).any() or any(0x10FFF0 <= ord(c) for c in text):
                    odd[i] = self._by_library(text)
            if odd:
                keep = np.ones(len(texts), bool)
                keep[list(odd)] = False
                cp = cp[np.repeat(keep, size)]
                size = np.where(keep, size, 0)
                at = np.concatenate([[0], np.cumsum(size)])
        s, e, doc = split(cp, at, self.spaced)
        h = tb.hashes(cp, s, e) if len(s) else np.empty(0, tb.U)
        keys, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        found = self._find(keys)
        for i in np.flatnonzero(found < 0).tolist():
            a, b = s[where[i]], e[where[i]]
            c = int(cp[a])
            if c >= _SPECIAL:
                ids = [list(self.special.values())[c - _SPECIAL]]
            else:
                piece = cp[a:b].tobytes().decode("utf-32-le").encode().decode("latin-1").translate(self.map)
                ids = self.encode_piece(piece)
            found[i] = self._add(int(keys[i]), ids)
        self.seen[found] += 1
        place = found[inverse]
        count = self.count[place]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[place] - (ends - count), count) + np.arange(total)]
        by_doc = np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(by_doc)])
        if not odd:
            return ids, cut
        rows = [np.array(odd[i], np.uint32) if i in odd else ids[cut[i] : cut[i + 1]] for i in range(len(texts))]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])

    def decode_bytes(self, ids: np.ndarray, cut: np.ndarray) -> list[bytes]:
        """UTF-8 of each text of a block, by offset table."""
        size = self.offset[ids.astype(np.int64) + 1] - self.offset[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.bytes[np.repeat(self.offset[ids] - (ends - size), size) + np.arange(total)]
        at = np.concatenate([[0], ends])[cut]
        out = [data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        if self.joined:
            return [x[:-1] for x in out]
        return [x if x.isascii() else x.decode("utf-8", "replace").encode() for x in out]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a worker."""
    return Vocabulary(path)


def text_blocks(column: pa.Array, most_chars: int = 1 << 19) -> Iterator[list[str]]:
    """Runs of whole texts; null as empty."""
    block, size = [], 0
    # A few rows at a time: the texts of a whole batch as strings would stand beside it.
    rows = column if isinstance(column, list) else (t for i in range(0, len(column), 512) for t in column.slice(i, 512).to_pylist())
    for t in rows:
        t = t or ""
        if block and size + len(t) > most_chars:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def _schema(base: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), more])


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as ``array<int>``."""
    prepare(docs.sparkSession)
    base = docs.select(*[c for c in docs.columns if c != out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            made = [v.encode_block(b) for b in text_blocks(batch.column(text))]
            ids = np.concatenate([m[0] for m in made]) if made else np.empty(0, np.uint32)
            count = np.concatenate([np.diff(m[1]) for m in made]) if made else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out])

    return base.mapInArrow(run, _schema(base, f"{out} array<int>"))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of each id list; null counts as no ids."""
    prepare(rows.sparkSession)
    base = rows.select(*[c for c in rows.columns if c != out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(ids).to_pylist()]
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            texts = v.decode_bytes(flat, np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.decode() for t in texts], pa.string())], [*batch.schema.names, out])

    return base.mapInArrow(run, _schema(base, f"{out} string"))


def round_trip_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, sending digests only."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            n, a, b = [], [], []
            for block in text_blocks(batch.column(text)):
                ids, cut = v.encode_block(block)
                n += np.diff(cut).tolist()
                raw = ids.astype("<u4").tobytes()
                a += [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
                b += [hashlib.sha256(x).hexdigest() for x in v.decode_bytes(ids, cut)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", text)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
