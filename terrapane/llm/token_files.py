"""Token ids in files: a static range asymmetric numeral system over shared frequencies.

Texts are tokenised once; then their ids are put in ascending order of the texts' ids
and cut into blocks at text ends.  One table of frequencies, counted over all ids,
serves every block.  A block is coded by itself on many interleaved lanes (id i goes
to lane i modulo lanes), so that blocks, and segments of a block, decode in parallel:
a checkpoint holds the lanes' states and the place in the stream where a segment
begins, and each segment has a checksum.  A file is a Parquet table with one block in
each row, because Spark can write and commit that to any store.

Where the tokenizer splits as GPT-2 does, its pattern never joins a run of characters
with what follows it, and the library encodes each distinct unit (white space and the
run after it) once while a worker remembers it.  Texts with white space outside ASCII,
texts that hold an added token, and all texts of other tokenizers are encoded whole.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.llm.common import _BASE, _IS_SPACE, _OTHER, Words, pieces, release, run_hashes, small_batches, staged, sums_by_text

MAGIC = b"TPR1"
SCALE = 20
LANES = 1024
SEGMENT = 256  # steps of all lanes between checkpoints
BLOCK = 2 * LANES * SEGMENT
LOW = np.uint64(1 << 32)


class Table:
    """Frequencies scaled to 2^SCALE: freq and first place by id, and the id at each place."""

    def __init__(self, counts: np.ndarray):
        counts = counts.astype(float)
        used = np.flatnonzero(counts)
        if len(used) < 2:  # a symbol never fills the whole range
            counts = counts.copy() if len(counts) > 1 else np.zeros(2)
            counts[:2] = np.maximum(counts[:2], 1)
            used = np.flatnonzero(counts)
        if len(used) >= 1 << SCALE:
            raise ValueError("more ids than the table has places")
        freq = np.zeros(len(counts), np.int64)
        freq[used] = np.maximum(1, np.floor(counts[used] / counts.sum() * (1 << SCALE)))
        # the rounding is spread over the frequent ids, who feel it least
        over = int(freq.sum()) - (1 << SCALE)
        for i in np.argsort(-freq, kind="stable"):
            if not over:
                break
            step = -over if over < 0 else min(over, int(freq[i]) // 2)
            freq[i] += step if over < 0 else -step
            over = 0 if over < 0 else over - step
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.at = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def _lanes(n: int) -> int:
    """Few ids use few lanes: a lane's state takes eight bytes."""
    return int(min(LANES, max(1, 1 << max(0, (n // 64).bit_length() - 1))))


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """n, lanes, segments; a checkpoint for each segment (words before it, states, checksum of its ids); the stream."""
    n = len(ids)
    k = _lanes(n)
    steps = -(-n // k)
    f, c = table.freq[ids], table.cum[ids]
    limit = f << np.uint64(64 - SCALE)
    x = np.full(k, LOW, np.uint64)
    out: list[np.ndarray] = []
    written, points = 0, []
    for t in range(steps - 1, -1, -1):
        a, b = t * k, min(n, t * k + k)
        xs = x[: b - a]
        over = xs >= limit[a:b]
        words = xs[over].astype(np.uint32)
        out.append(words)
        written += len(words)
        xs = np.where(over, xs >> np.uint64(32), xs)
        q = xs // f[a:b]
        x[: b - a] = (q << np.uint64(SCALE)) + (xs - q * f[a:b]) + c[a:b]
        if t % SEGMENT == 0:
            part = ids[a : min(n, a + SEGMENT * k)]
            points.append((written, x.astype("<u8").tobytes(), zlib.crc32(part.astype("<u4").tobytes())))
    stream = np.concatenate(out[::-1]).astype("<u4").tobytes() if out else b""
    head = [struct.pack("<4sIII", MAGIC, n, k, len(points))]
    head += [struct.pack("<II", written - w, crc) + states for w, states, crc in reversed(points)]
    return b"".join(head) + stream


def decode_block(data: bytes, table: Table, segment: int | None = None) -> np.ndarray:
    """The ids of a block, or of one of its segments alone.  Raises ValueError where a checksum differs."""
    magic, n, k, count = struct.unpack_from("<4sIII", data)
    if magic != MAGIC:
        raise ValueError("not a block")
    size = 8 + 8 * k
    points = [struct.unpack_from("<II", data, 16 + i * size) for i in range(count)]
    states = [np.frombuffer(data, "<u8", k, 24 + i * size) for i in range(count)]
    stream = np.frombuffer(data, "<u4", -1, 16 + count * size).astype(np.uint64)
    width = SEGMENT * k
    out = np.zeros(n, np.uint32)
    wanted = list(range(count)) if segment is None else [segment]
    whole = [s for s in wanted if (s + 1) * width <= n]
    for group in (whole, [s for s in wanted if s not in whole]):
        if not group:
            continue
        x = np.stack([states[s] for s in group]).astype(np.uint64)
        read = np.array([points[s][0] for s in group], np.int64)
        got = np.zeros((len(group), min(width, n - group[-1] * width)), np.uint32)
        for a in range(0, got.shape[1], k):
            m = min(k, got.shape[1] - a)
            xs = x[:, :m]
            place = xs & np.uint64((1 << SCALE) - 1)
            ids = table.at[place]
            got[:, a : a + m] = ids
            xs = table.freq[ids] * (xs >> np.uint64(SCALE)) + place - table.cum[ids]
            need = xs < LOW
            nth = np.cumsum(need, axis=1)
            if nth[:, -1].any():
                at = np.minimum(read[:, None] + nth - 1, max(0, len(stream) - 1))
                xs = np.where(need, (xs << np.uint64(32)) | stream[at], xs)
                read = read + nth[:, -1]
            x[:, :m] = xs
        for s, row in zip(group, got, strict=True):
            if zlib.crc32(row.astype("<u4").tobytes()) != points[s][1]:
                raise ValueError(f"segment {s}: checksum differs")
            out[s * width : s * width + len(row)] = row
    return out if segment is None else out[segment * width : (segment + 1) * width]


class UnitEncoder:
    """Ids of whole texts through the tokenizers library, which sees each distinct unit once while it is remembered.

    A table of fixed size remembers units; a unit whose place is taken, or all of them once they have `most` ids, are forgotten.
    """

    def __init__(self, tokenizer_json: str, bits: int = 21, most: int = 12_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        about = json.loads(tokenizer_json)
        added = {x["content"]: x["id"] for x in about.get("added_tokens") or [] if x["content"]}
        self.added = [x.encode() for x in added]
        split = about.get("pre_tokenizer") or {}
        self.by_unit = (
            split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space", True)
            and about["model"].get("type") == "BPE"
            and not any(about.get(x) for x in ("normalizer", "truncation", "padding"))
            and not about["model"].get("dropout")
        )
        # a token of such a vocabulary has a character for each byte
        self.width = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        if self.by_unit:
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.width[i] = len(token)
        self.shift, self.most = np.uint64(64 - bits), most
        self.key, self.check = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.at, self.size = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.flat, self.used = np.zeros(1 << 12, np.uint32), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(texts)
        return np.array([y for x in ids for y in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of the texts among them."""
        if not self.by_unit:
            return self._whole([x or "" for x in texts.to_pylist()])
        w = Words(texts)
        # units tile a text: from the end of the run before, or the text's beginning; white space at a text's end is one more
        n_words = np.diff(w.first)
        last = np.where(n_words > 0, w.end[np.maximum(w.first[1:] - 1, 0)] if len(w.end) else 0, w.text_at[:-1])
        trails = last < w.text_at[1:]
        text = np.concatenate([np.repeat(np.arange(len(n_words)), n_words), np.flatnonzero(trails)])
        end = np.concatenate([w.end, w.text_at[1:][trails]])
        before = np.concatenate([[0], w.end[:-1]]) if len(w.end) else w.end
        before[w.first[:-1][n_words > 0]] = w.text_at[:-1][n_words > 0]
        start = np.concatenate([before, last[trails]])
        order = np.lexsort((end, text)) if trails.any() else slice(None)
        text, start, end = text[order], start[order], end[order]
        odd = self._odd(w)
        own = np.flatnonzero(~odd[text]) if odd.any() else slice(None)
        at, size = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        at[own], size[own] = self._known(w.data, start[own], end[own])
        total = sums_by_text(size, np.searchsorted(text, np.arange(len(n_words) + 1)))
        ids, bound = _ragged(self.flat, at, size), np.concatenate([[0], np.cumsum(total)])
        odd = np.flatnonzero(odd)
        if not len(odd):
            return ids, bound
        whole = dict(zip(odd.tolist(), self._ids([texts[i].as_py() or "" for i in odd.tolist()]), strict=True))
        parts = [np.array(whole[i], np.uint32) if i in whole else ids[bound[i] : bound[i + 1]] for i in range(len(n_words))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _odd(self, w: Words) -> np.ndarray:
        """Which texts have white space outside ASCII, or may have an added token."""
        d = w.data
        out = np.zeros(len(w.text_at) - 1, bool)
        raw = d.tobytes() if self.added else b""
        for token in self.added:
            i = raw.find(token)
            while i >= 0:
                t = int(np.searchsorted(w.text_at, i, "right")) - 1
                out[t] = True
                i = raw.find(token, int(w.text_at[t + 1]))
        if len(d) < 2:
            return out
        lead = np.flatnonzero((d[:-1] == 0xC2) | ((d[:-1] >= 0xE1) & (d[:-1] <= 0xE3)))
        b1, b2, b3 = d[lead], d[lead + 1], d[np.minimum(lead + 2, len(d) - 1)]
        hit = (b1 == 0xC2) & ((b2 == 0x85) | (b2 == 0xA0)) | (b1 == 0xE1) & (b2 == 0x9A) & (b3 == 0x80) | (b1 == 0xE3) & (b2 == 0x80) & (b3 == 0x80)
        hit |= (b1 == 0xE2) & (b2 == 0x80) & ((b3 <= 0x8A) | (b3 == 0xA8) | (b3 == 0xA9) | (b3 == 0xAF)) | (b1 == 0xE2) & (b2 == 0x81) & (b3 == 0x9F)
        out[np.searchsorted(w.text_at, lead[hit], "right") - 1] = True
        return out

    def _known(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each unit's ids are in `flat`, and how many; new ones are encoded and remembered."""
        if not len(start):
            return start, start
        key, check = run_hashes(data, start, end, _BASE), run_hashes(data, start, end, _OTHER)
        if self.used > self.most:
            self.key[:], self.check[:], self.used = 0, 0, 0
        slot = key >> self.shift
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        new = np.flatnonzero((self.key[slot] != key) | (self.check[slot] != check))
        if not len(new):
            return at, size
        _, one, back = np.unique(key[new] ^ check[new] << np.uint64(1), return_index=True, return_inverse=True)
        if (key[new] != key[new][one][back]).any() or (check[new] != check[new][one][back]).any():  # two units fell together
            both = np.stack([key[new], check[new]], axis=1).view([("key", np.uint64), ("check", np.uint64)]).ravel()
            _, one, back = np.unique(both, return_index=True, return_inverse=True)
        one = new[one]
        # units with white space first and something else last can stand one after another
        alone = ~_IS_SPACE[data[start[one]]] | _IS_SPACE[data[end[one] - 1]]
        one, back = _reordered(one, back, np.argsort(alone, kind="stable"))
        ids, n = self._units(data, start[one], end[one], int((~alone).sum()))
        place = self.used + np.cumsum(n) - n
        self.used += len(ids)
        if self.used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used, np.uint32)])
        self.flat[self.used - len(ids) : self.used] = ids
        at[new], size[new] = place[back], n[back]
        slot = slot[one]
        self.key[slot] = key[one]
        kept = self.key[slot] == key[one]  # of two for one place the last stays
        for mine, value in ((self.check, check[one]), (self.at, place), (self.size, n)):
            mine[slot[kept]] = value[kept]
        return at, size


    def _units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, joined: int, many: int = 100) -> tuple[np.ndarray, np.ndarray]:
        """All ids of units, and how many each has.  The first `joined` are handed over many at a time; the tokens' bytes tell them apart."""
        raw = data.tobytes()
        units = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        texts = [b"".join(units[i : min(joined, i + many)]).decode() for i in range(0, joined, many)]
        found = self._ids(texts)
        ids = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        bytes_at = np.cumsum(self.width[ids])
        unit_at = np.cumsum(end[:joined] - start[:joined])
        last = np.searchsorted(bytes_at, unit_at)
        if joined and not (len(ids) and last[-1] < len(ids) and np.array_equal(bytes_at[last], unit_at)):
            raise ValueError("tokens that are not of their units' bytes")
        rest, sizes = self._whole([u.decode() for u in units[joined:]])
        return np.concatenate([ids, rest]), np.concatenate([np.diff(last, prepend=-1), np.diff(sizes)])


def _reordered(one: np.ndarray, back: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return one[order], place[back]


def _ragged(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[at : at + size] one after another."""
    if not len(at):
        return flat[:0]
    return flat[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _binary(flat: np.ndarray, bound: np.ndarray) -> pa.Array:
    """A binary for each run of `flat`."""
    width = flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bound) - 1, [None, pa.py_buffer((bound * width).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


#: The worker's encoder, up to 160 MB, which later tasks of the worker find warm.
_encoders: dict[int, UnitEncoder] = {}


def _encoder(tokenizer_json: str) -> UnitEncoder:
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = UnitEncoder(tokenizer_json)
    return _encoders[key]


def _tokenise(shared, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in pieces(batches, "text"):
            ids, bound = encoder(batch.column("text"))
            ids = np.insert(ids, bound[1:], end_id).astype(kind)
            bound = bound + np.arange(len(bound))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(np.diff(bound)), _binary(ids, bound)], ["doc_id", "tie", "n_tokens", "ids"])

    return run


def _flat(ids: pa.Array, kind: str) -> np.ndarray:
    """The ids of all rows, one row's after another's."""
    bound = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, ids.offset * 4)
    return np.frombuffer(ids.buffers()[2], np.uint8)[bound[0] : bound[-1]].view(kind) if bound[-1] > bound[0] else np.zeros(0, kind)


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(_flat(batch.column("ids"), kind), minlength=len(total))
            more[: len(total)] += total
            total = more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return run


def _code(shared, kind: str):
    """Blocks of about BLOCK ids, cut at text ends, with what a reader needs to know of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = Table(shared.value), TaskContext.get().partitionId()
        names, sizes, held, room, block, before = [], [], [], BLOCK, 0, 0

        def made() -> pa.RecordBatch:
            ids = np.concatenate(held)
            docs = pa.ListArray.from_arrays(pa.array([0, sum(map(len, names))], pa.int32()), pa.concat_arrays(names))
            n = pa.array([np.concatenate(sizes).tolist()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([before], pa.int64()), docs, n, pa.array([len(ids)], pa.int64()), pa.array([encode_block(ids, table)], pa.binary())],
                ["part", "block", "before", "doc_ids", "sizes", "n_tokens", "data"],
            )

        for batch in batches:
            ids, size = _flat(batch.column("ids"), kind), batch.column("n_tokens").to_numpy()
            bound = np.concatenate([[0], np.cumsum(size)])
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(bound, bound[i] + room, "right")) - 1)
                names.append(batch.column("doc_id").slice(i, j - i))
                sizes.append(size[i:j])
                held.append(ids[bound[i] : bound[j]].copy())
                room -= int(bound[j] - bound[i])
                i = j
                if i < batch.num_rows or room <= 0:
                    yield made()
                    block, before, room = block + 1, before + sum(map(len, held)), BLOCK
                    names, sizes, held = [], [], []
        if held:
            yield made()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Write the ids of every text of `docs`, each with `end_id` after it, to path/blocks, and the frequencies to path/table.

    Texts stand in ascending id order, null ids first; rows with equal ids by a hash of their texts.  A null text is
    empty, and its end is all it has.  An empty table makes files without blocks.  The table has a row for each id that
    occurs, at most as many as the tokenizer has tokens, which must be fewer than 2^SCALE.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    most = max(Tokenizer.from_str(tokenizer_json).get_vocab_size(with_added_tokens=True), end_id + 1)
    if most >= 1 << SCALE or end_id < 0:
        raise ValueError(f"{most} ids: the table has places for fewer than {1 << SCALE}")
    kind = "<u2" if most <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(tokenizer_json)
    name = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))
    rows = rows.mapInArrow(_tokenise(shared, end_id, kind), f"doc_id {name}, tie long, n_tokens long, ids binary")
    # the row's number lets equal ids and texts fall to several ranges
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "ids")
    counts = rows.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    with small_batches(spark):
        counts.coalesce(1).write.parquet(f"{path}/table")
    freq = spark.sparkContext.broadcast(_counts(spark, path))
    ordered = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    schema = f"part int, block long, before long, doc_ids array<{name}>, sizes array<long>, n_tokens long, data binary"
    with small_batches(spark):
        ordered.select("doc_id", "n_tokens", "ids").mapInArrow(_code(freq, kind), schema).write.option("compression", "none").parquet(f"{path}/blocks")
    release(rows)
    shared.destroy()
    freq.destroy()


def _counts(spark: SparkSession, path: str) -> np.ndarray:
    """At most one row for each id of the vocabulary."""
    found = spark.read.schema("id long, n long").parquet(f"{path}/table").toArrow()
    ids, n = found.column("id").to_numpy(), found.column("n").to_numpy()
    out = np.zeros(max(2, int(ids.max(initial=0)) + 1), np.int64)
    out[ids] = n
    return out


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every text in the files at `path`; with `ids`, the ids themselves too.

    start is the number of ids of all texts before it; ids_crc32 is taken over its ids as little-endian 32-bit numbers.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    parts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each partition
    starts, at = {}, 0
    for p in sorted(parts):
        starts[p], at = at, at + parts[p]
    freq = spark.sparkContext.broadcast((_counts(spark, path), starts))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, starts = freq.value
        table = Table(counts)
        for batch in batches:
            for row in range(batch.num_rows):
                got = decode_block(batch.column("data")[row].as_py(), table).astype("<u4")
                size = np.array(batch.column("sizes")[row].as_py(), np.int64)
                bound = np.concatenate([[0], np.cumsum(size)])
                start = starts[batch.column("part")[row].as_py()] + batch.column("before")[row].as_py() + bound[:-1]
                raw = memoryview(got.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
                out = [batch.column("doc_ids")[row].values, pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(got.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    return blocks.select("part", "before", "doc_ids", "sizes", "data").mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
