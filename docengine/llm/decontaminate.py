"""Benchmark decontamination: CGK embedding, repeated bit-sampling LSH over item-sized windows, exact edit distances.

1. A walk reads a window character by character; at every step a random bit of (table, step, character) decides whether it
   moves on. The characters read are the window's embedding, and texts a few edits apart read mostly the same ones, as walks
   that fall out of step meet again (the CGK random walk: edit distance becomes Hamming distance).
2. The embedding of an item-sized window is the row of the walks that begin at each of its characters, so one walk from each
   character of a document serves the windows of all items and sizes that hold it. A table samples some steps of a walk; the
   characters read there are its key. The tables take turns by place in the text, and items are posted under every place in
   every table, so a window has as many independent draws as it has characters.
3. A document's place and an item's place of one key make a candidate: the item-sized window on that diagonal, widened by the
   edits allowed and kept inside the place's own document.
4. Candidates are verified: the least edit distance between the item and any substring of the window, by Myers' bit vectors,
   many candidates at a time.

An exact copy is always found: its first walk is the item's first walk, which is no longer than the item. The share of other
copies found depends on the walk's length and the samples, which are set by the item's length (``STEPS``) from measured recall:
0.9 or more of what is within ``max_edits`` at 0 to 15 % of characters edited, for items of 1 to 90 words (see the tests).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import byte_view, free_name, process_cache, row_blocks, text_of
from .words import mix

#: Tables, which take turns by place.
TABLES = 8
MAX_EDITS = 0.2
#: By least item length in characters: steps of a walk, never more than that length, and how many of them are sampled.
STEPS = ((80, 48, 14), (54, 32, 14), (34, 20, 11), (20, 12, 8), (13, 8, 6), (9, 5, 4), (5, 3, 3), (2, 2, 2), (1, 1, 1))
#: Items sent to the tasks at a time (their index takes about 100 bytes a byte); a larger benchmark takes several passes.
BLOCK_BYTES = 2_000_000
#: Bytes of text walked at a time.
WALK_BYTES = 400_000
#: Items whose bit masks are held together: entries of their masks.
GROUP_MASKS = 4_000_000
#: Hits held at a time; a range of places with more is halved.
HITS = 6_000_000
#: Longer items, and fewer candidates at a time than this, are verified one by one; characters verified at a time.
MANY_WORDS, MANY, VERIFIED = 32, 96, 1_000_000
#: Candidates cut out of a text at a time, and characters of windows held until they are verified together.
MOST, HELD = 4096, 4_000_000
SEED, KEY = np.uint64(0x5851F42D4C957F2D), np.int64(-0x61C8864680B583EB)
BREAK = ord("\n")

LEAK = StructType([StructField("item", IntegerType()), StructField("start_word", LongType()), StructField("distance", IntegerType()), StructField("item_chars", IntegerType())])


def _flat(text: str) -> str:
    return " ".join(text.lower().split())


def _folded(texts: pa.Array) -> list[str]:
    """The texts as ``_flat`` leaves them; bytes that are not UTF-8 are replaced."""
    data, off = byte_view(texts)
    raw, off = data.tobytes(), off.tolist()
    return [_flat(raw[a:b].decode("utf-8", "replace")) for a, b in zip(off[:-1], off[1:], strict=True)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _symbols(codes: np.ndarray) -> np.ndarray:
    """64 random bits for each character: its name in keys, and whether a walk moves on, by step. Zeros at breaks, where a
    walk stays for good, so that it never reads the next text."""
    kept = process_cache()
    if "symbols" not in kept:
        kept["symbols"] = mix(np.arange(1 << 16, dtype=np.uint64) + SEED)
        kept["symbols"][BREAK] = 0
    return kept["symbols"][codes & np.uint32(0xFFFF)]


class Walks:
    """The index of items of about one length: the keys of all their places, in every table."""

    def __init__(self, ids: list[int], codes: list[np.ndarray], steps: int, samples: int, tables: int):
        self.steps, self.tables = steps, tables
        draw = np.random.default_rng(steps)
        self.sampled = [{0, *draw.permutation(np.arange(1, steps))[: samples - 1].tolist()} for _ in range(tables)]
        size = np.array([len(c) for c in codes])
        self.item = np.repeat(np.array(ids, np.int32), size)
        self.offset = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        symbols = _symbols(np.concatenate([x for c in codes for x in (c, np.full(steps + 1, BREAK, np.uint32))]))
        place = np.arange(size.sum()) + np.repeat(np.arange(len(codes)) * (steps + 1), size)
        left = np.repeat(size, size) - self.offset
        self.slot = np.uint64(64 - min(26, max(16, int(size.sum()).bit_length() + 4)))
        self.index = []
        for t in range(tables):
            key, last = self._keys(symbols, place, t)
            whole = np.flatnonzero(last - place < left)  # walks that stay inside the item
            order = whole[np.argsort(key[whole], kind="stable")].astype(np.int32)
            seen = np.zeros(1 << (64 - int(self.slot)), bool)
            seen[key[order] >> self.slot] = True
            self.index.append((seen, key[order], order))

    def _keys(self, symbols: np.ndarray, place: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, last place read) of the walks that begin at the places."""
        at, key, sampled = place.copy(), np.zeros(len(place), np.int64), self.sampled[table]
        s, moves, symbols = np.empty_like(at), np.empty_like(at), symbols.view(np.int64)
        for step in range(self.steps):
            if step:
                np.right_shift(s, (step + 7 * table) % 64, out=moves)
                np.bitwise_and(moves, 1, out=moves)
                at += moves
            np.take(symbols, at, out=s, mode="clip")  # places are within; clipping only spares a check
            if step in sampled:
                key += s
                key *= KEY
        return key.view(np.uint64), at

    def hits(self, symbols: np.ndarray, first: int, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, item, place in the item) of equal keys, for places begin..end of a text; ``symbols`` are its from ``first`` on."""
        found, total = [], 0
        for t, (seen, keys, post) in enumerate(self.index):
            place = np.arange(begin + (t - begin) % self.tables, end, self.tables)
            key, _ = self._keys(symbols, place - first, t)
            may = np.flatnonzero(seen[key >> self.slot])
            key, place = key[may], place[may]
            low = np.searchsorted(keys, key)
            count = np.searchsorted(keys, key, "right") - low
            some = np.flatnonzero(count)
            total += int(count.sum())
            found.append((place[some], low[some], count[some], post))
        if total > HITS and end - begin > 4 * self.tables:
            half = (begin + end) // 2
            yield from self.hits(symbols, first, begin, half)
            yield from self.hits(symbols, first, half, end)
            return
        for place, low, count, post in found:
            p = post[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
            yield np.repeat(place, count), self.item[p], self.offset[p]


class Group:
    """Some items with their bit masks."""

    def __init__(self, ids: list[int], codes: list[np.ndarray]):
        self.ids, self.codes = np.array(ids), codes
        self.order = np.argsort(self.ids)
        self.m = np.array([len(c) for c in codes])
        self.letters = np.unique(np.concatenate(codes))
        self.words = (self.m + 63) // 64
        self._masks: np.ndarray | None = None

    @property
    def masks(self) -> np.ndarray:
        """By word, item and letter (0 for all others), the places of the letter in the item."""
        if self._masks is None:
            out = np.zeros((int(self.words.max()), len(self.ids), len(self.letters) + 1), np.uint64)
            for i, c in enumerate(self.codes):
                at = np.arange(len(c))
                np.bitwise_or.at(out, (at // 64, i, np.searchsorted(self.letters, c) + 1), np.uint64(1) << (at % 64).astype(np.uint64))
            self._masks = out.reshape(len(out), -1)
        return self._masks

    def least_distances(self, item: np.ndarray, begin: np.ndarray, end: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For items of equally many words, the least distance to a substring of codes[begin:end], and where that first ends."""
        w, n, one = int(self.words[item[0]]), len(item), np.uint64(1)
        length = end - begin
        at = np.minimum(begin[:, None] + np.arange(int(length.max())), len(codes) - 1)
        text = codes[at]
        letter = np.minimum(np.searchsorted(self.letters, text), len(self.letters) - 1)
        letter = np.where((self.letters[letter] == text) & (at < end[:, None]), letter + 1, 0)
        rows = np.ascontiguousarray((letter + item[:, None] * (len(self.letters) + 1)).T)
        up, down = [np.full(n, ~np.uint64(0)) for _ in range(w)], [np.zeros(n, np.uint64) for _ in range(w)]
        top = ((self.m[item] - 1) % 64).astype(np.uint64)
        score = self.m[item].astype(np.int64)
        best, where = score.copy(), begin.astype(np.int64)
        masks = self.masks
        for t, row in enumerate(rows):
            more = less = np.uint64(0)
            for b in range(w):
                eq, p, d = masks[b][row], up[b], down[b]
                y = eq | d
                eq |= less
                x = (((eq & p) + p) ^ p) | eq
                plus, minus = d | ~(x | p), p & x
                if b == w - 1:
                    score += ((plus >> top) & one).astype(np.int64) - ((minus >> top) & one).astype(np.int64)
                out = plus >> np.uint64(63), minus >> np.uint64(63)
                plus, minus = plus << one | more, minus << one | less
                up[b], down[b] = minus | ~(y | plus), plus & y
                more, less = out
            better = score < best
            if better.any():
                best[better], where[better] = score[better], begin[better] + t + 1
        return best, where


class Items:
    """A block of benchmark items, ready to be searched for within ``max_edits`` of an item's characters."""

    def __init__(self, texts: list[str], max_edits: float = MAX_EDITS, tables: int = TABLES):
        if not 0 <= max_edits < 1:
            raise ValueError("max_edits must be from 0 to below 1")
        self.tables = tables
        self.flat = [_flat(t) for t in texts]
        self.masks = [self._mask(t) for t in self.flat]
        self.m = np.array([len(t) for t in self.flat], np.int64)
        self.k = np.array([int(max_edits * len(t)) for t in self.flat], np.int64)
        codes = [_codes(t) for t in self.flat]
        by_size = sorted((i for i, t in enumerate(self.flat) if t), key=lambda i: len(self.flat[i]))
        self.walks = []
        for least, steps, samples in STEPS:
            own = [i for i in by_size if len(self.flat[i]) >= least]
            by_size = by_size[: len(by_size) - len(own)]
            if own:
                self.walks.append(Walks(own, [codes[i] for i in own], steps, samples, tables))
        self.groups, self.group_of = [], np.zeros(len(texts), np.int64)
        ids, letters = [], set()
        for i in sorted((i for i, t in enumerate(self.flat) if t), key=lambda i: len(self.flat[i])):
            now = letters | set(self.flat[i])
            if ids and (len(ids) + 1) * (len(now) + 1) * (len(self.flat[i]) // 64 + 1) > GROUP_MASKS:
                self._close(ids, codes)
                ids, now = [], set(self.flat[i])
            ids.append(i)
            letters = now
        if ids:
            self._close(ids, codes)

    def _close(self, ids: list[int], codes: list[np.ndarray]) -> None:
        self.group_of[ids] = len(self.groups)
        self.groups.append(Group(ids, [codes[i] for i in ids]))

    @staticmethod
    def _mask(text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for k, c in enumerate(text):
            out[c] = out.get(c, 0) | 1 << k
        return out

    def distance(self, item: int, text: str) -> int:
        """Least edit distance between the item and any substring of ``text``."""
        return 0 if self.flat[item] in text else self._best(self.masks[item], len(self.flat[item]), text, False)[0]

    @staticmethod
    def _best(masks: dict[str, int], m: int, text: str, anchored: bool) -> tuple[int, int]:
        """The least distance to a substring, and its first end (Myers' bit vectors, one long integer a column); anchored: to a prefix."""
        full, last = (1 << m) - 1, 1 << (m - 1)
        up, down, score = full, 0, m
        best, where = m, 0
        for t, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            x = (((eq & up) + up) ^ up) | eq
            plus, minus = down | ~(x | up) & full, up & x
            y = eq | down
            if plus & last:
                score += 1
            elif minus & last:
                score -= 1
            plus, minus = plus << 1 & full | anchored, minus << 1 & full
            up, down = minus | ~(y | plus) & full, plus & y
            if score < best:
                best, where = score, t
        return best, where

    def candidates(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, begin, end): windows of the documents codes[starts[d]:ends[d]] that may hold the item."""
        runs, span = [], WALK_BYTES // self.tables * self.tables
        for walks in self.walks:
            for a in range(0, len(codes), span):
                b = min(a + span, len(codes))
                symbols = _symbols(np.concatenate([codes[a : b + walks.steps], np.full(walks.steps, BREAK, np.uint32)]))
                for place, item, offset in walks.hits(symbols, a, a, b):
                    if len(place):
                        runs.append(self._runs(np.searchsorted(starts, place, "right") - 1, item.astype(np.int64), place - offset, place - offset))
        if not runs:
            return (np.zeros(0, np.int64),) * 4
        doc, item, low, high = self._runs(*(np.concatenate(x) for x in zip(*runs, strict=True)))
        begin, end = np.maximum(low - self.k[item], starts[doc]), np.minimum(high + self.m[item] + self.k[item], ends[doc])
        keep = end - begin >= self.m[item] - self.k[item]
        return doc[keep], item[keep], begin[keep], end[keep]

    def _runs(self, doc: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ranges low..high of diagonals, by document and item; those no further apart than the edits allowed become one."""
        order = np.lexsort((low, item, doc))
        doc, item, low, high = doc[order], item[order], low[order], high[order]
        other = np.ones(len(doc), bool)
        other[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        shift = np.cumsum(other) << np.int64(40)
        so_far = np.maximum.accumulate(high + shift) - shift
        new = other.copy()
        new[1:] |= low[1:] - so_far[:-1] > self.k[item[1:]] + 1
        at = np.flatnonzero(new)
        return doc[at], item[at], low[at], np.maximum.reduceat(high, at)

    def verified(self, group: Group, own: np.ndarray, begin: np.ndarray, end: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(candidate, distance, begin of the match in its window) of the group's candidates within the edits allowed."""
        item = group.order[np.searchsorted(group.ids, own, sorter=group.order)]
        order = np.lexsort((end - begin, group.words[item]))
        words, length, a = group.words[item[order]], (end - begin)[order], 0
        text = lambda x, y: codes[x:y].tobytes().decode("utf-32-le", "surrogatepass")
        while a < len(order):
            b = int(np.searchsorted(words, words[a], "right"))
            b = a + max(1, int(np.searchsorted(length[a:b] * np.arange(1, b - a + 1), VERIFIED, "right")))
            part = order[a:b]
            if len(part) < MANY or words[a] > MANY_WORDS:
                got = [self._best(self.masks[i], int(self.m[i]), text(x, y), False) for i, x, y in zip(own[part].tolist(), begin[part].tolist(), end[part].tolist(), strict=True)]
                best, where = np.array([n for n, _ in got]), np.array([e for _, e in got]) + begin[part]
            else:
                best, where = group.least_distances(item[part], begin[part], end[part], codes)
            for c in np.flatnonzero(best <= self.k[own[part]]).tolist():
                i, x, e, score = int(own[part[c]]), int(begin[part[c]]), int(where[c]), int(best[c])
                back = self._best(self._mask(self.flat[i][::-1]), len(self.flat[i]), text(max(x, e - len(self.flat[i]) - score), e)[::-1], True)[1]
                yield int(part[c]), score, e - back - x
            a = b

    def leaks(self, texts: pa.Array) -> list[list[dict]]:
        """Per text: each item that occurs in it within the edits allowed, with the word in which its best match starts."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        held: list[tuple[np.ndarray, ...]] = []
        chars = 0
        for a, b in row_blocks(texts, WALK_BYTES) if self.groups else ():
            # no folded text or item has a break; each text begins where the tables' turns begin, so none depends on those before it
            flat = _folded(texts.slice(a, b - a))
            padded = [t + "\n" * (self.tables - len(t) % self.tables) for t in flat]
            codes = _codes("".join(padded))
            starts = np.cumsum([0, *(len(t) for t in padded)])[:-1]
            doc, item, begin, end = self.candidates(codes, starts, starts + [len(t) for t in flat])
            for x in range(0, len(doc), MOST):
                y = slice(x, x + MOST)
                size = (end - begin)[y]
                window = codes[np.repeat(begin[y] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                held.append((doc[y] + a, item[y], begin[y] - starts[doc[y]], size, window))
                chars += len(window)
                if chars > HELD:
                    self._keep(held, best)
                    held, chars = [], 0
        if held:
            self._keep(held, best)
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        last, flat = -1, [""]
        for (d, own), (score, begin) in sorted(best.items()):
            if d != last:
                last, flat = d, _folded(texts.slice(d, 1))
            start = begin + (flat[0][begin : begin + 1] == " ")
            out[d].append({"item": own, "start_word": flat[0].count(" ", 0, start), "distance": score, "item_chars": len(self.flat[own])})
        return out

    def _keep(self, held: list[tuple[np.ndarray, ...]], best: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Verify the windows held; ``best`` gets the least (distance, begin) by document and item."""
        doc, item, first, size, codes = (np.concatenate(x) for x in zip(*held, strict=True))
        end = np.cumsum(size)
        for g in np.unique(self.group_of[item]).tolist():
            own = np.flatnonzero(self.group_of[item] == g)
            for c, score, begin in self.verified(self.groups[g], item[own], (end - size)[own], end[own], codes):
                at = int(doc[own[c]]), int(item[own[c]])
                best[at] = min(best.get(at, (1 << 30, 0)), (score, begin + int(first[own[c]])))


def _items(texts: list[str], max_edits: float, tables: int) -> Items:
    """The block of items made ready; a worker keeps the last one for its next tasks."""
    key = hashlib.blake2b("\0".join(texts).encode("utf-8", "surrogatepass"), digest_size=16).digest(), len(texts), max_edits, tables
    kept = process_cache()
    if kept.get("items", (None,))[0] != key:
        kept["items"] = key, Items(texts, max_edits, tables)
    return kept["items"][1]


def _scanned(batches: Iterator[pa.RecordBatch], texts: list[str], tables: int, max_edits: float, text_col: str, name: str) -> Iterator[pa.RecordBatch]:
    items = _items(texts, max_edits, tables)
    kind = pa.list_(pa.struct([("item", pa.int32()), ("start_word", pa.int64()), ("distance", pa.int32()), ("item_chars", pa.int32())]))
    for batch in batches:
        rows = text_of(batch, text_col)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(items.leaks(rows), kind)], names=[*batch.schema.names, name])


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The benchmark's (id, text) rows in blocks of bounded bytes; one block at a time is held. Null and empty items are left out."""
    block, size = [], 0
    for row in benchmark.select(benchmark[id_col], benchmark[text_col].cast("string")).filter(F.length(F.trim(benchmark[text_col])) > 0).toLocalIterator():
        if block and size + len(row[1]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def scan_leaks(docs: DataFrame, items: list[str], text_col: str = "text", name: str = "leaks", tables: int = TABLES, max_edits: float = MAX_EDITS) -> DataFrame:
    """``docs`` with an array column ``name`` of (item, start_word, distance, item_chars); ``item`` indexes ``items``.

    One pass over whole texts, no shuffle. Null and empty texts have an empty array. Case and runs of white space don't
    count in the distance; ``max_edits`` is the share of the item's characters that may be edited. Of several matches of
    one item the least distance counts, then the first place. A row's result depends on its own text only, not on the rows
    beside it. Long texts are walked in parts; the items are sent to the tasks once a block.
    """
    kept = docs.drop(name)
    schema = StructType([*kept.schema.fields]).add(name, ArrayType(LEAK))
    return kept.mapInArrow(partial(_scanned, texts=items, tables=tables, max_edits=max_edits, text_col=text_col, name=name), schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, start_word, distance, item_chars): a row for each item that occurs in a document.

    Repeated documents and repeated items give rows each; null ids are kept as they are, null or blank items are left out.
    Without documents or items the result is empty. Other columns of either table are not read. The documents are read once
    for every ``BLOCK_BYTES`` of items.
    """
    spark: SparkSession = docs.sparkSession
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = None
    ids = StructType([StructField("item", IntegerType()), StructField("item_id", benchmark.schema[item_id].dataType)])
    for block in item_blocks(benchmark, item_id, item_text):
        hits = scan_leaks(own, [t for _, t in block], "text", "leaks", **options).select("doc_id", F.explode("leaks").alias("leak"))
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], ids)  # one block of items
        part = hits.select("doc_id", "leak.*").join(F.broadcast(names), "item").select("doc_id", "item_id", "start_word", "distance", "item_chars")
        out = part if out is None else out.union(part)
    return own.select("doc_id").limit(0).join(spark.createDataFrame([], ids)).selectExpr("doc_id", "item_id", "0L AS start_word", "0 AS distance", "0 AS item_chars") if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents in which an item occurs; columns, nulls, repeated and empty rows stay as they are."""
    out = docs
    name = free_name(docs, "_leaks")
    for block in item_blocks(benchmark, item_id, item_text):
        out = scan_leaks(out, [t for _, t in block], text_col, name, **options).filter(F.size(name) == 0).drop(name)
    return out
