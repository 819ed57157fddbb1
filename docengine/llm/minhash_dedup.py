"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Each text becomes a set of distinct k-word shingles (64-bit hashes), a 128-bit fingerprint of that set, and a signature
   of ``coords`` least hashes. Equal sets are one node from here on, so exact copies are never paired.
2. Each node is posted under its (coordinate, value) pairs. Two sets that agree in ``matches`` of ``coords`` coordinates
   share one of any ``coords - matches + 1`` of them: only that prefix is posted, rarest values first, so a value that
   very many nodes hold is skipped by all that have rarer ones. Values of one node only are not posted.
3. All pairs of a short list (``SHORT``) are tested at once. Inside a longer one, members are first paired with one leader (the most central one), then those outside its component
   with another, not with each other. Linked members share a component, so only pairs across components remain; those are
   all tested. No list is cut. Lists are dealt to tasks in parts (``LIST``), so a long one is no single task's.
4. Collisions of a pair are counted while the lists are joined, on a few bits of each coordinate (equal coordinates have equal
   bits, so none is lost); a bitmap of each set bounds the similarity (two bitmaps differ in no more bits than the sets in
   members). Pairs that pass are confirmed on the full sets.
5. Components come from alternating star steps. Steps are written to the shared folder, and deleted once they are used up.

A node's full set is made once, in the first round that needs it, of the texts that a Bloom filter of fixed size lets through;
the join is the same at every size. exactly 0.8 is lost with a probability below 5e-5 (24 coordinates, 11 matches); more similar ones less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_view, drop_step, materialize, only_rows, row_blocks, text_of
from .components import connected_components
from .words import shingle_sets, word_hashes

COORDS, MATCHES = 24, 11
#: Bins of a set's bitmap.
BITMAP = 2048
#: What pairs are tested by while lists are joined.
BRIEF = ("n", "q0", "q1")
#: Rounds of pairing with leaders before all pairs across components are tested.
LEADER_ROUNDS = 2
#: Members of a list that one task joins, on average.
LIST = 500
#: Nodes of a value up to which all pairs of its list are made at once.
SHORT = 16


def _salts(n: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(b"minhash%d" % i, digest_size=8).digest(), "little") | 1 for i in range(n)], np.uint64)


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted shingle hashes, offsets by row) of blocks of the batch's texts."""
    texts = text_of(batch, "text")
    for a, b in row_blocks(texts):
        h, first, _ = word_hashes(*byte_view(texts.slice(a, b - a)))
        yield (a, *shingle_sets(h, first, shingle))


def _fingerprint(u: np.ndarray) -> bytes | None:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None


def _bitmaps(u: np.ndarray, off: np.ndarray, first: int, rows: int = 2000) -> np.ndarray:
    """Of a few texts: which of ``BITMAP`` bins hold a member of the set, as 64-bit words."""
    last = min(first + rows, len(off) - 1)
    own = u[off[first] : off[last]]
    seen = np.zeros((last - first) * BITMAP, bool)
    seen[np.repeat(np.arange(last - first), np.diff(off[first : last + 1])) * BITMAP + (own >> np.uint64(64 - BITMAP.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(seen).view(np.int64)


def _brief(sig: np.ndarray) -> np.ndarray:
    """The last bits of each coordinate, side by side in two longs a row."""
    out = np.zeros((len(sig), 2), np.uint64)
    half = -(-sig.shape[1] // 2)
    few = 64 // half
    for k in range(sig.shape[1]):
        out[:, k // half] |= (sig[:, k].view(np.uint64) & np.uint64((1 << few) - 1)) << np.uint64(few * (k % half))
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], shingle: int, coords: int) -> Iterator[pa.RecordBatch]:
    salts = _salts(coords)
    tags = np.arange(coords, dtype=np.int64) << 32
    for batch in batches:
        prints, sizes, signs, maps, brief = [], [], [], [], []
        for _, u, off in _sets(batch, shingle):
            n = np.diff(off)
            full = np.flatnonzero(n)
            sig = np.zeros((len(n), coords), np.int64)
            for k in range(coords if len(full) else 0):
                v = (u ^ (u >> np.uint64(31)) ^ salts[k]) * salts[k]
                sig[full, k] = np.minimum.reduceat(v >> np.uint64(32), off[:-1][full]).astype(np.int64)
            prints += [_fingerprint(u[off[i] : off[i + 1]]) for i in range(len(n))]
            sizes.append(n)
            signs.append(sig | tags)
            brief.append(_brief(sig))
            maps += [_bitmaps(u, off, c) for c in range(0, len(n), 2000)]
        if not prints:
            continue
        lists = lambda flat, k: pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, k, dtype=np.int32), flat)
        cols = [batch.column(0), pa.array(prints, pa.binary()), pa.array(np.concatenate(sizes)), *(pa.array(x) for x in np.ascontiguousarray(np.concatenate(brief).T)), lists(np.concatenate(signs).ravel(), coords), lists(np.concatenate(maps), BITMAP // 64)]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "fp", "n_shingles", *BRIEF[1:], "sig", "bits"])


def _set_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Full sets of the texts whose fingerprint is the one asked for, a block of texts at a time."""
    for batch in batches:
        want = batch.column(1).to_pylist()
        for a, u, off in _sets(batch, shingle):
            out = {}
            for i in range(len(off) - 1):
                own = u[off[i] : off[i + 1]]
                if _fingerprint(own) == want[a + i]:
                    out[want[a + i]] = own.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], names=["fp", "members"])


def _confirm(batches: Iterator[pa.RecordBatch], up: int, down: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(down * both >= up * (len(p) + len(q) - both))
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])


class NearDuplicates:
    """One run over a table; ``result()`` has a row for every input row, ``nodes`` and ``labels`` are its parts."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (80, 100), coords: int = COORDS, matches: int = MATCHES):
        if not 0 < matches <= coords <= 64 or not 0 < similarity[0] <= similarity[1]:
            raise ValueError("matches are 1 to coords, coords up to 64, the similarity above 0 and up to 1")
        self.shingle, (self.up, self.down), self.matches, self.coords = shingle, similarity, matches, coords
        self.docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        self.signed = materialize(self.docs.mapInArrow(partial(_sign, shingle=shingle, coords=coords), f"doc_id {kind}, fp binary, n_shingles long, {', '.join(f'{c} long' for c in BRIEF[1:])}, sig array<long>, bits array<long>"), "signed")
        first = [F.first(c).alias(c) for c in (*BRIEF[1:], "sig", "bits")]
        self.nodes = materialize(self.signed.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").cast("int").alias("n"), *first), "nodes")
        self.labels = self._link()

    @cached_property
    def repeated(self) -> bool:
        """Whether an id comes with one set more than once."""
        return not self.signed.filter("fp is not null").groupBy("doc_id", "fp").count().filter("count > 1").isEmpty()

    def _posted(self) -> DataFrame:
        """(token, fp, held, central, *BRIEF): the prefix of each node's tokens, rarest first, without tokens that only it has.

        ``held`` counts the nodes of a token, ``central`` sums that over the node's tokens.
        """
        every = self.nodes.select("fp", F.explode("sig").alias("token"))
        held = every.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
        ranked = every.join(held.hint("merge"), "token").groupBy("fp").agg(F.sum("held").alias("central"), F.array_sort(F.collect_list(F.struct("held", "token"))).alias("t"))
        # the node's other tokens are its own, come first and fill a part of the prefix
        taken = F.expr(f"slice(t, 1, greatest(0, size(t) - {self.matches - 1}))")
        about = ranked.join(self.nodes.select("fp", *BRIEF).hint("merge"), "fp")
        return materialize(about.select("fp", *BRIEF, "central", F.explode(taken).alias("t")).select("t.token", "fp", "t.held", "central", *BRIEF), "posted")

    def _sets(self, need: DataFrame) -> DataFrame:
        """(fp, members): the full sets of the nodes (fp, rep), in one pass over the texts."""
        texts = only_rows(self.docs, "doc_id", need, "rep")
        texts = texts.join(need, texts["doc_id"].eqNullSafe(need["rep"])).select("text", "fp")
        sets = texts.mapInArrow(partial(_set_rows, shingle=self.shingle), "fp binary, members binary")
        return materialize(sets.dropDuplicates(["fp"]) if self.repeated else sets, "sets")

    def _link(self) -> DataFrame:
        posted, labels = self._posted(), None
        lists = posted.filter(F.col("held") > SHORT)
        sets: list[DataFrame] = []
        for step in range(LEADER_ROUNDS + 1):
            now = lists.withColumn("label", F.col("fp"))
            if labels is not None:
                now = lists.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
            if step < LEADER_ROUNDS:
                pairs = self._with_leaders(now, step)
                near = self._near(pairs if step else pairs.union(self._short(posted)))
            else:
                near = self._across(now)
            found = self._confirmed(near, sets)
            if labels is None or not found.isEmpty():
                before, labels = labels, connected_components(found if labels is None else found.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
                drop_step(before)
            drop_step(found)
        for used in (posted, *sets):
            drop_step(used)
        return labels

    @staticmethod
    def _salted(now: DataFrame) -> DataFrame:
        """A list's members dealt to parts by a hash."""
        return now.withColumn("salt", F.pmod(F.xxhash64("fp"), F.ceil(F.col("held") / LIST)).cast("int"))

    @staticmethod
    def _by_part(lead: DataFrame) -> DataFrame:
        """One row for each part of a list, whose leader is the struct ``l``."""
        parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("held") / LIST).cast("int") - 1)).alias("salt")
        return lead.select("token", parts, F.col("l.fp").alias("lead"), *[F.col(f"l.{c}").alias(f"lead_{c}") for c in ("label", *BRIEF)])

    def _leaders(self, now: DataFrame) -> DataFrame:
        """The most central member of each open list; a list is open if its members are of several components."""
        best = F.max(F.struct("central", "fp", "label", *BRIEF))
        lead = now.groupBy("token").agg(best.alias("l"), F.max("held").alias("held"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        return self._by_part(lead.filter("lo < hi"))

    def _short(self, posted: DataFrame) -> DataFrame:
        """(a, b): all pairs of the lists of up to ``SHORT`` nodes that may be near."""
        members = posted.filter(F.col("held") <= SHORT).groupBy("token").agg(F.collect_list(F.struct("fp", *BRIEF)).alias("m")).filter(F.size("m") > 1)
        later = lambda x: F.filter("m", lambda y: (x["fp"] < y["fp"]) & self._may(lambda c: x[c], lambda c: y[c]))
        pairs = F.flatten(F.transform("m", lambda x: F.transform(later(x), lambda y: F.struct(x["fp"].alias("a"), y["fp"].alias("b")))))
        return members.select(F.explode(pairs).alias("p")).select("p.a", "p.b")

    def _with_leaders(self, now: DataFrame, step: int) -> DataFrame:
        """(a, b): the members of each open list and its leader, if they may be near; in later steps, the leader is one by hash of
        those outside the component of the most central one."""
        now = self._salted(now)
        lead = self._leaders(now)
        if step:
            apart = now.join(lead, ["token", "salt"]).filter(F.col("label") != F.col("lead_label"))
            turn = F.max(F.struct(F.xxhash64("fp", F.lit(step)), "fp", "label", *BRIEF))
            lead = self._by_part(apart.groupBy("token").agg(turn.alias("l"), F.max("held").alias("held")))
        pairs = now.join(lead, ["token", "salt"]).filter((F.col("label") != F.col("lead_label")) & self._may(F.col, lambda c: F.col(f"lead_{c}")))
        return pairs.select(F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b"))

    def _near(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose bitmaps allow the threshold, once each."""
        pairs = materialize(pairs.distinct(), "pairs")
        ends = materialize(self._ends(pairs), "ends")
        about = only_rows(self.nodes.select("fp", "n", "bits"), "fp", ends, "fp")
        own = lambda s: about.select(F.col("fp").alias(s), F.col("n").alias(f"{s}_n"), F.col("bits").alias(f"{s}_bits")).hint("merge")
        near = materialize(pairs.join(own("a"), "a").join(own("b"), "b").filter(self._bound("a_", "b_")).select("a", "b"), "near")
        drop_step(pairs)
        drop_step(ends)
        return near

    def _across(self, now: DataFrame) -> DataFrame:
        """Near pairs (a, b) of an open list that lie in different components, except that members of its leader's component
        are not paired with each other. The join itself tests them, so that only near pairs come out of it, and each in
        the list of the least token that both are posted under."""
        now = self._salted(now)
        lead = self._leaders(now).select("token", "salt", "lead_label")
        open_ = now.join(lead, ["token", "salt"])
        tokens = open_.groupBy("fp").agg(F.collect_list("token").alias("tokens"))
        open_ = open_.join(tokens.hint("merge"), "fp").join(self.nodes.select("fp", "bits").hint("merge"), "fp")
        wide = ("fp", "label", *BRIEF, "bits", "tokens")
        one = open_.filter(F.col("label") != F.col("lead_label")).select("token", "salt", "lead_label", *[F.col(c).alias(f"a_{c}") for c in wide])
        # the other side goes to all parts of the list
        two = open_.select("token", F.explode(F.sequence(F.lit(0), F.ceil(F.col("held") / LIST).cast("int") - 1)).alias("part"), F.col("token").alias("other"), *[F.col(c).alias(f"b_{c}") for c in wide]).drop("token")
        once = (F.col("b_label") == F.col("lead_label")) | (F.col("a_fp") < F.col("b_fp"))
        on = (F.col("token") == F.col("other")) & (F.col("salt") == F.col("part")) & (F.col("a_label") != F.col("b_label")) & once & self._may(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")) & self._bound("a_", "b_")
        first = F.array_min(F.array_intersect("a_tokens", "b_tokens")) == F.col("token")
        pairs = one.join(two.hint("merge"), on & first)
        return materialize(pairs.select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b")).distinct(), "near")

    def _may(self, a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        """Whether the sizes of two nodes allow the threshold, and the last bits of their coordinates enough collisions."""
        half = -(-self.coords // 2)
        few, same = 64 // half, F.lit(0)
        for q, coords in (("q0", half), ("q1", self.coords - half)):
            differ = apart = a(q).bitwiseXOR(b(q))
            for k in range(1, few):
                differ = differ.bitwiseOR(F.shiftrightunsigned(apart, k))
            mask = sum(1 << (few * k) for k in range(coords))
            same = same + F.lit(coords) - F.bit_count(differ.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")))
        least, most = F.least(a("n"), b("n")).cast("long"), F.greatest(a("n"), b("n")).cast("long")
        return (least * self.down >= most * self.up) & (same >= self.matches)

    def _bound(self, a: str, b: str) -> Column:
        """Whether the bitmaps of two nodes allow the threshold: sets of a similarity of up / down differ in at most
        (n_a + n_b) * (down - up) / (down + up) members, and their bitmaps in no more bits than that."""
        apart = F.aggregate(F.zip_with(a + "bits", b + "bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        return apart.cast("long") * (self.down + self.up) <= (F.col(a + "n").cast("long") + F.col(b + "n")) * (self.down - self.up)

    @staticmethod
    def _ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()

    def _confirmed(self, near: DataFrame, sets: list[DataFrame]) -> DataFrame:
        """Those of the pairs (a, b) that reach the threshold on their full sets; sets not made yet are added to ``sets``."""
        ends = materialize(self._ends(near), "ends")
        need = ends
        for made in sets:
            need = need.join(made.select("fp"), "fp", "left_anti")
        need = materialize(need.join(self.nodes.select("fp", "rep"), "fp"), "need")
        sets.append(self._sets(need))
        drop_step(need)
        whole = sets[0]
        for made in sets[1:]:
            whole = whole.union(made)
        if len(sets) > 1:  # the first round's sets are all wanted
            whole = only_rows(whole, "fp", ends, "fp")
        side = lambda s: whole.select(F.col("fp").alias(s), F.col("members").alias(f"set_{s}")).hint("merge")
        ready = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
        found = materialize(ready.mapInArrow(partial(_confirm, up=self.up, down=self.down), "a binary, b binary"), "links")
        drop_step(near)
        drop_step(ends)
        return found

    def classes(self) -> DataFrame:
        """(fp, label, component_id, rep): each node's component, the least document id in it, and in the node itself."""
        own = self.nodes.select("fp", "rep").join(self.labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        least = own.groupBy("label").agg(F.min("rep").alias("component_id"))
        return own.join(least, "label").select("fp", "label", "component_id", "rep")

    def result(self) -> DataFrame:
        of = self.classes().select("fp", "component_id")
        return self.signed.join(of, "fp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Nulls and empty texts have no shingles and are linked with nothing. Rows of equal texts share a component. Of repeated
    ids each row has its own set; a null id never is a component's id unless all ids in it are null. An empty table gives
    an empty one. Other columns are not read, whatever their names.
    """
    return NearDuplicates(docs, **options).result()


def _printed(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = []
        for _, u, off in _sets(batch, shingle):
            prints += [_fingerprint(u[off[i] : off[i + 1]]) for i in range(len(off) - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.binary())], names=[*batch.schema.names, "fp"])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without all but one row of each group of near-duplicates: of the rows with the group's least id, one stays.

    Rows without words all stay. Columns stay as they are.
    """
    run = NearDuplicates(docs, id_col, text_col, **options)
    stay = run.classes().filter(F.col("rep").eqNullSafe(F.col("component_id"))).groupBy("label").agg(F.min_by(F.struct("fp", "rep"), "fp").alias("s")).select(F.col("s.fp").alias("_fp"), F.col("s.rep").alias("_id"))
    many = run.repeated
    own = docs.select(docs[id_col].alias("_key"), docs[text_col].cast("string").alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    kind = own.schema["_key"].dataType.simpleString()
    row = own.schema["_row"].dataType.simpleString()
    printed = own.mapInArrow(partial(_printed, shingle=options.get("shingle", 5)), f"_key {kind}, text string, _row {row}, fp binary").drop("text")
    full = printed.filter("fp is not null").join(stay, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp")))
    if many:
        full = full.dropDuplicates(["fp"])
    return full.select("_row.*").union(printed.filter("fp is null").select("_row.*"))
