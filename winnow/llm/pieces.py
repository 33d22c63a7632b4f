"""SentencePiece encoding and decoding with byte offsets into the original text.

1. `CharMap` reads the compiled character map of a model: a double-array trie over UTF-8 bytes whose values point at
   replacements.  Normalising takes the longest prefix of what is left that the trie knows, writes its replacement,
   and notes for each normalised character which bytes of the source it came from.  An empty map is the identity.
2. The normalised text is cut before each run of word marks.  No piece holds a mark after another character (checked when
   the model is loaded), so no merge crosses a cut and each segment is encoded on its own: the pair whose union has the
   best score merges first, of equal ones the leftmost; characters no piece covers become byte pieces.  Segments
   repeat, so they are kept in a cache with a bound on its bytes.
3. Each piece goes back through the alignment to the span of source bytes it stands for.

A task holds a slice of a few MB of text (a longer document is a slice of its own) and the cache; there is no shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import map_batches, slices, text_bytes

MARK = "▁"
CACHE_BYTES = 192 << 20
#: Types of pieces in a model file: fixed values of its format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
LOST = float("-inf")
ENCODED = "ids array<int>, starts array<int>, ends array<int>"


# ---------------------------------------------------------------- model files


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            c = b[i]
            n |= (c & 127) << shift
            i, shift = i + 1, shift + 7
            if c < 128:
                return n, i

    while i < len(b):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class CharMap:
    """The compiled character map: longest-prefix replacement over the bytes of UTF-8."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4)) if size else []
        self.texts = blob[4 + size :]

    def longest(self, b: bytes, i: int, end: int) -> tuple[int, bytes | None]:
        """(bytes taken, replacement) at b[i:end]: the longest key that begins there, else one character as it is (None)."""
        units, found, value = self.units, 0, 0
        if units:
            at = self._child(0)
            for k in range(i, end):
                at ^= b[k]
                unit = units[at]
                if unit & 0x800000FF != b[k]:
                    break
                at ^= self._offset(unit)
                if unit >> 8 & 1:
                    found, value = k + 1 - i, units[at] & 0x7FFFFFFF
        if found:
            return found, self.texts[value : self.texts.index(b"\0", value)]
        c = b[i]
        return min(end - i, 1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4), None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _child(self, at: int) -> int:
        return at ^ self._offset(self.units[at])


class Model:
    """A BPE model with byte fallback, read from its file's bytes."""

    def __init__(self, data: bytes):
        pieces, norm, kind = [], {}, 1
        trainer: dict = {}
        for number, value in fields(data):
            if number == 1:
                one = dict(fields(value))
                pieces.append((one.get(1, b"").decode(), struct.unpack("<f", one[2])[0] if 2 in one else 0.0, one.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
                kind = trainer.get(3, 1)
            elif number == 3:
                norm = dict(fields(value))
        self.map = CharMap(norm.get(2, b""))
        self.add_prefix, self.squash, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        if kind != 2 or not trainer.get(35) or trainer.get(24) or not self.escape:
            raise ValueError("only BPE models with byte fallback and escaped white space before words are read")
        if any(t in (USER, UNUSED) for _, _, t in pieces) or any(MARK in p.lstrip(MARK) for p, _, t in pieces if t == NORMAL):
            raise ValueError("models with pieces of users, unused pieces or pieces across words are not read")
        self.score = {p: s for p, s, t in pieces if t == NORMAL}
        self.id_of = {p: k for k, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.byte_ids = {int(p[1:-1], 16): k for k, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.surface = [p.replace(MARK, " ").encode() if t == NORMAL else b"" for p, _, t in pieces]
        for k, (_, _, t) in enumerate(pieces):
            if t == UNKNOWN:
                self.surface[k] = trainer.get(44, b" \xe2\x81\x87 ")
        self.marked = [p.startswith(MARK) and t == NORMAL for p, _, t in pieces]
        self.byte_of = {k: v for v, k in self.byte_ids.items()}
        self.dtype, self.code = (np.dtype("<u2"), "H") if len(pieces) < 1 << 16 else (np.dtype("<u4"), "I")
        #: How many characters of the normalised text a piece takes; of byte pieces the first of a character takes it.
        self.chars = np.array([len(p) if t == NORMAL else 0 for p, _, t in pieces], dtype=np.int64)
        self.chars[[k for k, x in self.byte_of.items() if x & 0xC0 != 0x80]] = 1
        self.is_byte = np.array([t == BYTE for _, _, t in pieces], dtype=bool)
        self.end_id = next((k for k, (p, _, t) in enumerate(pieces) if t == CONTROL and p == trainer.get(47, b"</s>").decode()), None)

    # ------------------------------------------------------------ normalising

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, source byte at which each of its characters begins, with a last entry)."""
        if not self.map.units and not self.squash:
            if not text:
                return "", np.zeros(1, np.int64)
            out = text.replace(" ", MARK)
            wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            sizes = 1 + (wide > 0x7F).astype(np.int64) + (wide > 0x7FF) + (wide > 0xFFFF)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            return (MARK + out, np.concatenate(([0], starts))) if self.add_prefix else (out, starts)
        b = text.encode()
        out, at = [], []
        i, n = 0, len(b)
        longest = self.map.longest
        if self.squash:
            while i < n:
                k, new = longest(b, i, n)
                if (b[i : i + k] if new is None else new) != b" ":
                    break
                i += k
        if i == n:
            return "", np.full(1, n, np.int64)
        if self.add_prefix:
            out.append(MARK)
            at.append(i)
        after_space = self.squash
        while i < n:
            k, new = longest(b, i, n)
            piece = (b[i : i + k] if new is None else new).decode("utf-8", "replace")
            if after_space:
                piece = piece.lstrip(" ")
            if piece:
                out.append(piece.replace(" ", MARK))
                at += [i] * len(piece)
                after_space = self.squash and piece.endswith(" ")
            i += k
        done = "".join(out)
        past = n
        if self.squash:
            kept = done.rstrip(MARK)
            if len(kept) < len(done):
                past = at[len(kept)]
                done, at = kept, at[: len(kept)]
        return done, np.array([*at, past], dtype=np.int64)

    # ------------------------------------------------------------ merging

    def merge(self, segment: str) -> list[str]:
        """The symbols a segment ends as."""
        parts, score = list(segment), self.score
        if len(parts) > 64:
            return self._merge_long(parts)
        get = score.get
        gain = [get(a + b, LOST) for a, b in zip(parts, parts[1:])]
        while gain:
            best = max(gain)
            if best == LOST:
                break
            i = gain.index(best)
            one = parts[i] + parts[i + 1]
            parts[i] = one
            del parts[i + 1], gain[i]
            if i:
                gain[i - 1] = get(parts[i - 1] + one, LOST)
            if i < len(gain):
                gain[i] = get(one + parts[i + 1], LOST)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        score, n = self.score, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            s = score.get(parts[i] + parts[j])
            if s is not None:
                heapq.heappush(heap, (-s, i, j, len(parts[i]), len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if len(parts[i]) != a or len(parts[j]) != b or after[i] != j:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p]

    def segment_ids(self, segment: str) -> bytes:
        """The ids of a segment, in the type `dtype`."""
        get, ids = self.id_of.get, []
        for p in self.merge(segment):
            k = get(p)
            if k is not None:
                ids.append(k)
            else:
                ids += [self.byte_ids[x] for x in p.encode("utf-8", "surrogatepass")]
        return array(self.code, ids).tobytes()

    # ------------------------------------------------------------ decoding

    def decode(self, ids: list[int]) -> str:
        """The text of ids: a word mark is a space, that of the added prefix goes, byte pieces join to characters (bytes that
        form none are U+FFFD each), control ids are nothing."""
        out, run = [], bytearray()
        strip, some = self.add_prefix or self.squash, False
        byte_of, surface = self.byte_of, self.surface
        for k in ids:
            if k in byte_of:
                run.append(byte_of[k])
                continue
            if run:
                out.append(whole_characters(bytes(run)))
                run.clear()
                some = True
            s = surface[k]
            if strip:
                if some:
                    strip = False
                elif self.marked[k]:
                    s = s[1:]
                    strip = self.squash
                some = some or bool(s)
            out.append(s)
        if run:
            out.append(whole_characters(bytes(run)))
        return b"".join(out).decode()


def whole_characters(b: bytes) -> bytes:
    """b with each byte that belongs to no well-formed character as U+FFFD."""
    try:
        b.decode()
        return b
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(b):
            for n in (1, 2, 3, 4):
                try:
                    b[i : i + n].decode()
                except UnicodeDecodeError:
                    continue
                if i + n <= len(b):
                    out.append(b[i : i + n])
                    break
            else:
                n = 1
                out.append("�".encode())
            i += n
        return b"".join(out)


# ---------------------------------------------------------------- whole texts


SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Kept(dict):
    """Ids by segment, in two generations that hold at most `most` bytes together: when the younger has half of them the
    older goes, but for what was asked for meanwhile.  Long segments are not kept."""

    #: What an entry takes besides its characters and ids: two objects' heads and a place in the table.
    ENTRY = 210

    def __init__(self, ids_of: Callable[[str], bytes], most: int, longest: int = 64):
        super().__init__()
        self.ids_of, self.most, self.longest, self.held, self.older = ids_of, most, longest, 0, {}

    def __missing__(self, segment: str) -> bytes:
        ids = self.older.get(segment) or self.ids_of(segment)
        if len(segment) <= self.longest:
            self.held += self.ENTRY + 2 * len(segment) + len(ids)
            if 2 * self.held > self.most:
                self.older = dict(self)
                self.clear()
                self.held = self.ENTRY + 2 * len(segment) + len(ids)
            self[segment] = ids
        return ids


class Encoder:
    """Ids and source spans of whole texts."""

    def __init__(self, model: Model, cache_bytes: int = CACHE_BYTES):
        self.model, self.cache = model, Kept(model.segment_ids, cache_bytes)

    def encode(self, text: str, end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first byte, past byte) of the pieces of a text, with an end id of no bytes if asked for.

        The mark of the added prefix stands for no byte.  The byte pieces of a character that was not changed take one
        byte each, those of a changed one all its bytes.
        """
        m = self.model
        norm, at = m.normalise(text)
        ids = np.frombuffer(b"".join(map(self.cache.__getitem__, SEGMENT.findall(norm))), m.dtype).astype(np.int32)
        taken = m.chars[ids]
        past = np.cumsum(taken)
        first = past - np.maximum(taken, 1)
        starts, ends = at[first], at[past]
        byte = np.flatnonzero(m.is_byte[ids])
        if len(byte):
            lead = np.flatnonzero(np.append(True, (first[byte][1:] != first[byte][:-1]) | (np.diff(byte) != 1)))
            size = np.diff(np.append(lead, len(byte)))
            place = np.arange(len(byte)) - np.repeat(lead, size)
            one = np.flatnonzero(ends[byte] - starts[byte] == np.repeat(size, size))
            starts[byte[one]] += place[one]
            ends[byte[one]] = starts[byte[one]] + 1
        if end and m.end_id is not None:
            last = at[-1]
            ids, starts, ends = np.append(ids, np.int32(m.end_id)), np.append(starts, last), np.append(ends, last)
        return ids, starts.astype(np.int32), ends.astype(np.int32)


# ---------------------------------------------------------------- DataFrames


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(key: str, data: bytes, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """One encoder a worker: tasks that follow one another in it share the model and what is kept, which has a bound."""
    if (key, cache_bytes) not in _encoders:
        _encoders.clear()
        _encoders[key, cache_bytes] = Encoder(Model(data), cache_bytes)
    return _encoders[key, cache_bytes]


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))


def _kept(batch: pa.RecordBatch, left_out: str, i: int, j: int) -> list[pa.Array]:
    return [batch.column(k).slice(i, j - i) for k in range(batch.num_columns) if batch.schema.field(k).name != left_out]


def encode(docs: DataFrame, model_path: str, text_col: str = "text", end: bool = True, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """docs without text_col, with ids, starts and ends: of each piece its id and the span of bytes of the text's UTF-8 it
    stands for, in order.

    A null text counts as empty; an empty one has the end id only; texts of any length are encoded whole; repeated rows
    all stay; an empty table gives an empty result.  Columns of docs named ids, starts or ends are replaced.
    """
    with open(model_path, "rb") as f:  # a file of the driver: its bytes go to the tasks
        data = f.read()
    Model(data)  # says at once if the model can't be read
    key = hashlib.sha256(data).hexdigest()
    rows = docs.drop("ids", "starts", "ends").withColumn(text_col, F.col(text_col).cast("string"))
    kept = [f for f in rows.schema.fields if f.name != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared.value, cache_bytes)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            _, off = text_bytes(texts)
            for i, j in slices(off, 1 << 20):
                found = [encoder.encode(t or "", end) for t in texts.slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([*_kept(batch, text_col, i, j), *(_lists([x[k] for x in found]) for k in range(3))], names=[*(f.name for f in kept), "ids", "starts", "ends"])

    return map_batches(rows, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), ENCODED]))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with text_col: the text that each array of ids decodes to.  A null array, and one without ids, is the empty text;
    an id that the model has not got fails.  A column named text_col is replaced."""
    with open(model_path, "rb") as f:
        data = f.read()
    key = hashlib.sha256(data).hexdigest()
    rows = rows.drop(text_col)
    shared = rows.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _encoder(key, shared.value).model
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            sizes = np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            for i, j in slices(sizes, 1 << 18):
                flat, cut = ids.slice(i, j - i).flatten().to_numpy(), (sizes[i : j + 1] - sizes[i]).tolist()
                texts = [model.decode(flat[a:z].tolist()) for a, z in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([*_kept(batch, "", i, j), pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return map_batches(rows, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{text_col}` string"]))


def op11_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; nulls, blanks, long texts, repeats and empty tables as in encode.  n_bytes: where
    the span of the last piece ends."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    rows = decode(encoded.select("doc_id", "ids", F.element_at("ends", -1).cast("bigint").alias("n_bytes")), path)
    return rows.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"), "n_bytes",
    )


ORACLE_SQL: dict[str, str] = {}
