"""Token ids in a fixed-width bit-packed binary format.

Documents are dealt into shards by ranges of their id and sorted there; each shard is a sequence of blocks.  A block
holds whole documents: their ids in the fewest bits that the vocabulary needs, packed back to back, with the offset of
each document's first token, so numpy unpacks a block at once or any document alone.  Blocks are rows of a Parquet
table, which Spark's committer writes: a lost executor leaves no half-written shard.

Texts are encoded by the ``tokenizers`` library.  Byte-level BPE never merges across the pieces of its pre-tokenizer, so
the ids of a piece are reused wherever the piece comes again.  Pieces are cut for a whole batch of texts at once, by
byte classes; texts with characters beyond those classes, and tokenizers of another kind, go to the library as they are.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

END_ID = 2
BLOCK_IDS = 1 << 18
#: Pieces whose ids a Python worker remembers (about 200 bytes each), bytes of texts and new pieces it handles at a time.
REMEMBERED = 600_000
BATCH_BYTES, PIECES = 8_000_000, 4000
_BLANK, _SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(6)
#: Class of each byte; of the letters beyond ASCII those up to U+017F count, as two bytes each (lead bytes C3 to C5).
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[32], _CLASS[[9, 10, 13]], _CLASS[48:58] = _BLANK, _SPACE, _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[0x80:0xC0] = _CLASS[0xC3:0xC6] = _LETTER
_BLOCKS = "shard int, block long, bits int, n_ids long, first_id long, last_id long, doc_ids array<long>, starts array<int>, counts array<int>, packed binary"
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_BLOCK_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), _LONGS, _INTS, _INTS, pa.binary())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits per id, the high bit first, padded to whole bytes."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    out = [np.packbits((ids[at : at + 65536, None].astype(np.uint32) >> shifts & 1).astype(np.uint8)).tobytes() for at in range(0, len(ids), 65536)]
    return b"".join(out)


def unpack(packed: bytes, bits: int, count: int, start: int = 0) -> np.ndarray:
    """``count`` ids from the ``start``-th on, reading only their bytes."""
    if bits == 16:
        return np.frombuffer(packed, ">u2", count, 2 * start).astype("<u4")
    first, last = start * bits // 8, -(-(start + count) * bits // 8)
    flat = np.unpackbits(np.frombuffer(packed, np.uint8, last - first, first))[start * bits - 8 * first :][: count * bits]
    weights = (1 << np.arange(bits - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
    return (flat.reshape(count, bits).astype(np.uint64) @ weights).astype("<u4")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_bits(path: str, end_id: int = END_ID) -> int:
    size = max(_tokenizer(path).get_vocab_size(with_added_tokens=True), end_id + 1)
    return max(1, (size - 1).bit_length())


def piece_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pieces of the byte-level pre-tokenizer begin, for non-empty texts of known byte classes laid end to end.

    A blank belongs to the run of letters, digits or marks after it; of a longer run of white space only the last
    character can.  An apostrophe that begins a piece takes a contraction's letters with it.
    """
    kind = _CLASS[data]
    first = np.zeros(len(data) + 1, bool)
    first[text_starts] = first[-1] = True
    white = kind <= _SPACE
    after = np.zeros(len(data), np.uint8)
    after[1:] = kind[:-1]
    after[text_starts] = _SPACE
    ends_run = ~first[1:] & np.append(~white[1:], False)
    start = np.where(white, (after > _SPACE) | ends_run, (after != _BLANK) & (after != kind))
    start[text_starts] = True
    quote = np.flatnonzero((data == 39) & start)
    quote = quote[~first[quote + 1]]
    one = data[quote + 1]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    far = quote[~short]
    far = far[~first[far + 2]]
    pair = data[far + 1].astype(np.int32) << 8 | data[far + 2]
    far = far[np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])]
    for at, n in ((quote[short], 2), (far, 3)):
        start[at + 1] = False
        start[(at + n)[at + n < len(data)]] = True
    return np.flatnonzero(start)


def _byte_strings(values: pa.LargeBinaryArray) -> list[bytes]:
    _, offsets, raw = values.buffers()
    ends, whole = np.frombuffer(offsets, np.int64)[: len(values) + 1].tolist(), raw.to_pybytes() if raw else b""
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


class Encoder:
    """Encodes batches of texts; results equal ``encode(text, add_special_tokens=False)`` for each.

    ``place`` has the number of each piece met so far; ids, begins and sizes of all pieces stand in flat arrays.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.tok = _tokenizer(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.line = self._one("\n")
        self.by_piece = self._cuts_pieces()
        self.place: dict[bytes, int] = {}
        self.ids, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int32)

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _cuts_pieces(self) -> bool:
        """Whether the tokenizer is byte-level BPE as it comes: no normalizer, the usual pieces, no added blank."""
        told = json.loads(self.tok.to_str())
        before, model = told["pre_tokenizer"] or {}, told["model"]
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        plain = told["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout") and told["truncation"] is None and told["padding"] is None
        return bool(usual and plain and len(self.line) == 1)

    def _add(self, names: list[bytes], ids: list[np.ndarray], sizes: np.ndarray) -> None:
        self.place.update(zip(names, range(len(self.place), len(self.place) + len(names))))
        self.ids, self.sizes = np.concatenate((self.ids, *ids)), np.concatenate((self.sizes, sizes.astype(np.int32)))

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode new pieces, many to a call: a line end between pieces is a piece of its own."""
        white = [p for p in pieces if p.isspace()]
        words = [p for p in pieces if not p.isspace()]
        if white:
            ids = [self._one(p.decode()) for p in white]
            self._add(white, ids, np.array([len(x) for x in ids]))
        for at in range(0, len(words), PIECES):
            part = words[at : at + PIECES]
            flat = np.array(self.tok.encode_batch_fast([(b"\n".join(part) + b"\n").decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(flat == self.line[0])
            self._add(part, [np.delete(flat, ends)], np.diff(ends, prepend=-1) - 1)

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        get = self.place.get
        found = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(found < 0).tolist()
        if new:
            self._learn([pieces[i] for i in new])
            found[new] = [self.place[pieces[i]] for i in new]
        return found

    def _trim(self) -> None:
        """Forget the pieces that came after the first ``remembered``, which tend to be the rare ones."""
        if len(self.place) > self.remembered:
            while len(self.place) > self.remembered:
                self.place.popitem()
            self.sizes = self.sizes[: self.remembered]
            self.ids = self.ids[: int(self.sizes.sum())]

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered pieces, one after another, and where each piece's ids end."""
        n = self.sizes[numbers]
        ends = np.cumsum(n, dtype=np.int64)
        begin = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[numbers]
        return self.ids[np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], ends

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each of the UTF-8 texts."""
        out = [np.empty(0, np.uint32)] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if self.by_piece and text and not any(s in text for s in self.special):
                plain.append(i)
            elif text:
                out[i] = self._one(text.decode())
        if plain:
            data = np.frombuffer(b"".join([texts[i] for i in plain]), np.uint8)
            starts = np.concatenate(([0], np.cumsum([len(texts[i]) for i in plain])))
            bad = _CLASS[data] == _OTHER
            bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs among the letters
            if bad.any():
                odd = np.unique(np.searchsorted(starts, np.flatnonzero(bad), side="right") - 1)
                for k in odd.tolist():
                    out[plain[k]] = self._one(texts[plain[k]].decode())
                plain = np.delete(plain, odd).tolist()
                data = np.frombuffer(b"".join([texts[i] for i in plain]), np.uint8)
                starts = np.concatenate(([0], np.cumsum([len(texts[i]) for i in plain], dtype=np.int64)))
        if plain:
            cuts = piece_starts(data, starts[:-1])
            ends = pa.py_buffer(np.append(cuts, len(data)).astype(np.int64))
            coded = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, ends, pa.py_buffer(data)]).dictionary_encode()
            numbers = self._numbers(_byte_strings(coded.dictionary))[np.asarray(coded.indices)]
            flat, sizes = self._gather(numbers)
            stops = sizes[np.searchsorted(cuts, starts[1:]) - 1].tolist()
            for i, a, b in zip(plain, [0, *stops], stops):
                out[i] = flat[a:b]
            self._trim()
        return out


@lru_cache(maxsize=1)
def _encoder(path: str, remembered: int) -> Encoder:
    return Encoder(path, remembered)


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, remembered: int = REMEMBERED, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Encode, pack and write all documents in ascending id order (null ids last); return the written blocks.

    ``remembered`` pieces and ``batch_bytes`` of texts at a time (one text at least) bound a worker's memory; results
    don't depend on them.  Null and empty texts hold the end id alone.  Repeated ids keep their rows, in the order of
    their texts.  Extra columns are ignored; an empty table gives no blocks.
    """
    bits = vocabulary_bits(tokenizer, end_id)
    schema = pa.schema([(x.split()[0], t) for x, t in zip(_BLOCKS.split(", "), _BLOCK_TYPES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block = _encoder(tokenizer, remembered), 0
        keys, parts, held, shard = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            known = [k for k in keys if k is not None] or [None]
            row = [[shard], [block], [bits], [int(counts.sum())], [known[0]], [known[-1]], [keys], [(np.cumsum(counts) - counts).tolist()], [counts.tolist()], [pack(np.concatenate(parts), bits)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + batch_bytes, side="right")))
                shard = batch.column(2)[at].as_py()
                for key, ids in zip(batch.column(0).slice(at, to - at).to_pylist(), encode([t or b"" for t in texts.slice(at, to - at).to_pylist()])):
                    keys.append(key)
                    parts.append(np.append(ids, np.uint32(end_id)))
                    held += len(ids) + 1
                    if held >= BLOCK_IDS:
                        yield flush()
                        block += 1
                        keys, parts, held = [], [], 0
                at = to
        if keys:
            yield flush()

    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("id").asc_nulls_last(), "text")
    return materialise(dealt.withColumn("shard", F.spark_partition_id()).mapInArrow(run, _BLOCKS), "tokens")


def read_documents(blocks: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, unpacked from the stored blocks.

    ``start`` is the number of ids of all documents before it.  ``ids_crc32`` covers its ids as little-endian unsigned
    32-bit integers.  Rows without an id come last; repeated ids give a row each; no blocks give no rows.
    """
    out = "shard int, block long, id long, local long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids = unpack(row["packed"], row["bits"], row["n_ids"])
                n, raw = len(row["counts"]), ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + c)]) for a, c in zip(row["starts"], row["counts"])]
                cols = [[row["shard"]] * n, [row["block"]] * n, row["doc_ids"], row["starts"], row["counts"], crc]
                kinds = [pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["shard", "block", "id", "local", "n_tokens", "ids_crc32"])

    sizes = blocks.groupBy("shard", "block").agg(F.sum("n_ids").alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    starts = sizes.select("shard", "block", inside.alias("before")).join(shards, "shard")
    starts = materialise(starts.select("shard", "block", (F.col("before") + F.col("shard_start")).alias("first")), "token-starts")
    found = blocks.mapInArrow(run, out).join(starts, ["shard", "block"])
    return found.select("id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(blocks: DataFrame, id_value: int) -> list[np.ndarray]:
    """Random access: the ids of one document (one array for each row that has the id).

    The blocks' id bounds are compared, which Parquet's statistics answer for blocks elsewhere; of a block only the
    document's own bytes are unpacked.
    """
    rows = blocks.where((F.col("first_id") <= id_value) & (F.col("last_id") >= id_value)).collect()
    return [unpack(r["packed"], r["bits"], c, a) for r in rows for d, a, c in zip(r["doc_ids"], r["starts"], r["counts"]) if d == id_value]
