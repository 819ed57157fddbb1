"""Token-ID output in training order.

Documents are tokenised and packed, with an end mark after each, into sequences of a fixed number of tokens; each task
packs the rows of its own input split. A keyed Feistel permutation with cycle-walking gives every sequence a global slot,
and slots fall into shards of a fixed number of sequences. Tasks that hold whole shards, dealt by range, write them with a
fixed stride: sequence ``i`` of a shard starts at byte ``i * stride``, so a reader can go on anywhere. A shard is written
under another name and renamed; one that exists is left as it is if it holds the same bytes, so a job that died can be run
again, and the job fails if it holds others.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import new_dir, process_cache, row_blocks, text_of

#: Where public vocabularies are looked for unless a path is given: a file of base64 tokens and ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation of the byte-level vocabulary of 50,256 tokens.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
LENGTH = 512
PER_SHARD = 4096
#: Bytes of sequences that one task places at most, if there are that many shards.
TASK_BYTES = 256_000_000
#: Words whose token ids a worker remembers.
REMEMBERED = 400_000


class Tokenizer:
    """Token ids as little-endian 16-bit bytes; remembers the ids of words that come again."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        #: Tokens that begin with a blank: in a row of words, each word's first one.
        self.first = np.zeros(1 << 16, bool)
        self.first[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True
        # pieces never cross a space that a non-space follows, so a text in which every space is such is encoded word by word
        self.apart = re.compile(r" (?:\s|$)")

    def _whole(self, text: str) -> bytes:
        ids = array("H", self.encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __call__(self, text: str) -> bytes:
        if self.apart.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        return self._whole(first) + b"".join(self._words(rest))

    def count(self, text: str) -> int:
        """How many tokens the text has."""
        if self.apart.search(text):
            return len(self._whole(text)) // 2
        first, *rest = text.split(" ")
        return (len(self._whole(first)) + sum(map(len, self._words(rest)))) // 2

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a blank before it; those not remembered are encoded in one go."""
        out = list(map(self.known.get, words))
        if None in out:
            gaps = [k for k, x in enumerate(out) if x is None]
            new = [words[k] for k in gaps]
            ids = np.array(self.encoding.encode_ordinary(" " + " ".join(new)), "<u2")
            at, raw = np.flatnonzero(self.first[ids]).tolist(), ids.tobytes()
            found = [raw[2 * a : 2 * b] for a, b in zip(at, [*at[1:], len(ids)], strict=True)] if len(at) == len(new) else [self._whole(" " + w) for w in new]
            for k, x in zip(gaps, found, strict=True):
                out[k] = x
            self.known.update(zip(new[: max(0, REMEMBERED - len(self.known))], found, strict=False))
        return out


def tokenizer(shared: Broadcast) -> Tokenizer:
    """The worker's tokenizer: built once, so that its words serve all tasks of the process."""
    kept, digest = process_cache(), shared.value[0]
    if kept.get("tokenizer", ("", None))[0] != digest:
        kept["tokenizer"] = (digest, Tokenizer(shared.value[1]))
    return kept["tokenizer"][1]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str]]:
    for batch in batches:
        texts = text_of(batch, "text")
        for a, b in row_blocks(texts):
            yield from zip(batch.column(0).slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist(), strict=True)


def _packed(batches: Iterator[pa.RecordBatch], shared: Broadcast, length: int, end: int) -> Iterator[tuple[int, list, bytes]]:
    """(number within the task, ids of the documents in it, token bytes): full sequences, the last one filled up with end marks."""
    encode, stop = tokenizer(shared), np.array([end], "<u2").tobytes()
    stride, held, n = 2 * length, bytearray(), 0
    ids: list = []
    for doc, text in _texts(batches):
        held += encode(text) + stop
        ids.append(doc)
        while len(held) >= stride:
            yield n, ids, bytes(held[:stride])
            n += 1
            del held[:stride]
            ids = [doc] if held else []
    if held:
        yield n, ids, bytes(held) + stop * ((stride - len(held)) // 2)


def _counts(batches: Iterator[pa.RecordBatch], shared: Broadcast, length: int) -> Iterator[pa.RecordBatch]:
    count, tokens = tokenizer(shared).count, 0
    for _, text in _texts(batches):
        tokens += count(text) + 1
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([-(-tokens // length)], pa.int64())], names=["part", "sequences"])


def feistel(index: np.ndarray, size: int, key: str, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network on the next even number of bits, walked until the value is in range."""
    half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def _slotted(batches: Iterator[pa.RecordBatch], shared: Broadcast, length: int, end: int, starts: Broadcast, total: int, key: str, per_shard: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    start, promised = starts.value.get(part, (0, 0))
    seen = 0

    def batch(rows: list) -> pa.RecordBatch:
        slots = feistel(np.array([start + r[0] for r in rows], np.int64), total, key)
        return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(slots // per_shard), pa.array([start + r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(id_type)), pa.array([r[2] for r in rows], pa.binary())], names=["slot", "shard", "sequence", "doc_ids", "tokens"])

    rows: list = []
    for r in _packed(batches, shared, length, end):
        seen += 1
        if seen > promised:
            break
        rows.append(r)
        if len(rows) == 1024:
            yield batch(rows)
            rows = []
    if seen != promised:
        raise RuntimeError(f"split {part} had {promised} sequences when counted and another number now; materialise the input first")
    if rows:
        yield batch(rows)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _written(batches: Iterator[pa.RecordBatch], uri: str, per_shard: int, total: int, stride: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive by slot, whole shards in a task; each shard is written, read back and described row by row."""
    files, root = fs.FileSystem.from_uri(uri)

    def close(shard: int, rows: list) -> pa.RecordBatch:
        path, n = f"{root}/{shard_name(shard)}", min(per_shard, total - shard * per_shard)
        if [r[0] for r in rows] != list(range(shard * per_shard, shard * per_shard + n)):
            raise RuntimeError(f"shard {shard} is incomplete")
        if files.get_file_info(path).type == fs.FileType.NotFound:
            tmp = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
            with files.open_output_stream(tmp) as f:
                for r in rows:
                    f.write(r[3])
            files.move(tmp, path)
        with files.open_input_file(path) as f:
            back = f.read()
        if len(back) != n * stride or any(back[k * stride : (k + 1) * stride] != r[3] for k, r in enumerate(rows)):
            raise RuntimeError(f"{path} holds other sequences than these; use another folder")
        sums = [zlib.crc32(back[k * stride : (k + 1) * stride]) for k in range(n)]
        cols = [pa.array([r[0] for r in rows]), pa.array([shard] * n, pa.int64()), pa.array([k * stride for k in range(n)], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], batch.schema.field("doc_ids").type), pa.array(sums, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["slot", "shard", "offset", "sequence", "doc_ids", "crc32"])

    now, rows = None, []
    for batch in batches:
        for slot, shard, sequence, ids, tokens in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if shard != now and rows:
                yield close(now, rows)
                rows = []
            now = shard
            rows.append((slot, sequence, ids, tokens))
    if rows:
        yield close(now, rows)


def write_token_shards(docs: DataFrame, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: str = "order", end: int = END) -> DataFrame:
    """(slot, shard, offset, sequence, doc_ids, crc32): a row for each sequence, as it was read back from its shard under ``uri``.

    ``doc_ids`` lists the documents with tokens in the sequence (an end mark is one), in order; ``sequence`` is its number
    before the permutation. Null and empty texts are an end mark alone; repeated rows are written each; null ids stay null.
    An empty table writes no shard. A folder that holds the shards of other texts, splits or parameters is refused, as a whole or
    by the first shard that differs; nothing in it is changed. ``docs`` must give the same splits when read twice, as files do; if it doesn't, the job
    fails rather than write wrong shards. Only the two named columns are read.
    """
    spark = docs.sparkSession
    uri = uri or new_dir(spark, "tokens")
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    with open(vocabulary, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    shared = spark.sparkContext.broadcast((digest, load_ranks(vocabulary)))  # fixed size: the vocabulary's
    counted = own.mapInArrow(partial(_counts, shared=shared, length=length), "part int, sequences long")
    numbers, total = {}, 0
    for r in sorted(counted.collect()):  # a row a split
        numbers[r["part"]] = (total, r["sequences"])
        total += r["sequences"]
    starts = spark.sparkContext.broadcast(numbers)  # two numbers a split
    from pyspark.sql.pandas.types import to_arrow_type

    kind = own.schema["doc_id"].dataType
    packed = StructType([StructField("slot", LongType()), StructField("shard", LongType()), StructField("sequence", LongType()), StructField("doc_ids", ArrayType(kind)), StructField("tokens", BinaryType())])
    slotted = own.mapInArrow(partial(_slotted, shared=shared, length=length, end=end, starts=starts, total=max(1, total), key=key, per_shard=per_shard, id_type=to_arrow_type(kind)), packed)
    shards = max(1, -(-total // per_shard))
    files, root = fs.FileSystem.from_uri(uri)
    files.create_dir(root, recursive=True)
    index = {"sequences": total, "length": length, "bytes_per_token": 2, "stride": 2 * length, "per_shard": per_shard, "shards": shards if total else 0, "key": key, "end": end, "vocabulary": digest}
    if files.get_file_info(f"{root}/index.json").type != fs.FileType.NotFound:
        with files.open_input_file(f"{root}/index.json") as f:
            if json.loads(f.read()) != index:
                raise ValueError(f"{uri} holds the shards of another table or of other parameters")
    else:
        with files.open_output_stream(f"{root}/index.json") as f:
            f.write(json.dumps(index).encode())
    out = StructType([StructField("slot", LongType()), StructField("shard", LongType()), StructField("offset", LongType()), StructField("sequence", LongType()), StructField("doc_ids", ArrayType(kind)), StructField("crc32", LongType())])
    parts = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * 2 * length // TASK_BYTES)))
    # ranges of shards by arithmetic: no sampling pass, and no shard is cut
    dealt = slotted.repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int")).sortWithinPartitions("slot")
    return dealt.mapInArrow(partial(_written, uri=uri, per_shard=per_shard, total=total, stride=2 * length), out)


def read_slots(uri: str, slot: int, count: int) -> np.ndarray:
    """``count`` sequences from ``slot`` on, one row each: sequential reads that can resume at any slot."""
    files, root = fs.FileSystem.from_uri(uri)
    with files.open_input_file(f"{root}/index.json") as f:
        index = json.loads(f.read())
    rows = []
    while count > 0 and slot < index["sequences"]:
        shard, at = divmod(slot, index["per_shard"])
        n = min(count, index["per_shard"] - at, index["sequences"] - slot)
        with files.open_input_file(f"{root}/{shard_name(shard)}") as f:
            rows.append(np.frombuffer(f.read_at(n * index["stride"], at * index["stride"]), "<u2").reshape(n, index["length"]))
        slot, count = slot + n, count - n
    return np.concatenate(rows) if rows else np.zeros((0, index["length"]), "<u2")
