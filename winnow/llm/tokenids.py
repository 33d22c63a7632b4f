"""Token-id output: whole texts to ids, Re-Pair grammar compression per shard, files read back by random access.

Documents are dealt by ranges of their id, sorted, and cut into shards of a few MB of text.  A shard is one row of a
Parquet table: `part` and `shard` (in document order), `first_token` (ids of the part before it), `tokens`, and
`payload`, a self-contained block:

    8 bytes    magic "RePair01"
    6 x int64  documents, rules, symbols, width in bytes of a symbol, base (ids below it are tokens), flags
    int64[]    document ids         uint8[]  1 where the document id is null
    int64[]    symbols before each document, with a last entry
    int64[]    tokens before each document, with a last entry
    int64[]    expansion length of each rule
    symbol[]   left and right side of each rule, then the sequence

Symbol base+r stands for rule r, whose sides are tokens or earlier rules.  No rule spans two documents, so one
document decodes alone, and expansion lengths lead to any token of it without decoding what comes before.
"""

from __future__ import annotations

import math
import re
import sys
import types
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kit import map_batches, scratch, slices, text_bytes

MAGIC = b"RePair01"
END_ID = 1
SHARD_BYTES = 4 << 20
PART_BYTES = 48 << 20
#: The split of the word-level tokenizers this module has a fast path for, after lower-casing.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of visible ASCII, Latin letters and signs and ASCII white space: their case and class are the same everywhere.
PLAIN = re.compile("[!-~\xa1-\u022f \t-\r]*")
#: SPLIT for lower-cased texts of that kind: their letters end at U+02AF.
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u02af", "0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN_SPLIT = re.compile(f"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBER}]|[^ \t-\r{_LETTER}{_NUMBER}]+")


# ---------------------------------------------------------------- texts to ids


class Pieces(dict):
    """Ids by piece, with a bound on the bytes held: over it the cache starts anew.  Long pieces are not kept."""

    #: What an entry takes besides its characters and ids: two objects' heads and a place in the table.
    ENTRY = 200

    def __init__(self, ids_of: Callable[[str], bytes], most: int, longest: int = 64):
        super().__init__()
        self.ids_of, self.most, self.longest, self.held = ids_of, most, longest, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.ids_of(piece)
        if len(piece) <= self.longest:
            self.held += self.ENTRY + 4 * len(piece) + len(ids)
            if self.held > self.most:
                self.drop()
                self.held = self.ENTRY + 4 * len(piece) + len(ids)
            self[piece] = ids
        return ids

    def drop(self) -> None:
        self.clear()
        self.held = 0


class Encoder:
    """Ids of whole texts, equal to those of the tokenizers library.

    A tokenizer of the known kind (NFC, white space to one space, lower case, SPLIT, byte-level BPE) encodes each piece
    of SPLIT on its own, so ids are looked up by piece, and only a new piece goes through the library's BPE model.  Texts
    with characters whose class or case libraries may see differently, or with markup of special tokens, are cut at
    ASCII white space, which no piece spans, and such words are encoded by the library as they are; so are whole
    texts, with other tokenizers.
    """

    def __init__(self, path: str, cache_bytes: int = 96 << 20):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size < 60_000 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        spec = json.loads(self.tokenizer.to_str())
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        self.fast = (
            [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex"), x.get("behavior"), x.get("invert"), (x.get("pattern") or {}).get("Regex")) for x in pre.get("pretokenizers", [])] == [("Split", None, None, "Removed", True, SPLIT), ("ByteLevel", False, False, None, None, None)]
            and all(not (x["lstrip"] or x["rstrip"] or x["normalized"] or x["single_word"]) and x["content"].startswith("<|") for x in spec.get("added_tokens", []))
        )
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level BPE writes other bytes as U+0100...
        extra = iter(range(0x100, 0x200))
        self.byte = {k: chr(k if k in keep else next(extra)) for k in range(256)}
        self.pieces = Pieces(self.piece, cache_bytes)

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join([self.byte[x] for x in piece.encode()])
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def plain(self, text: str) -> bytes | None:
        """The ids, if the text has plain characters only."""
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, PLAIN_SPLIT.findall(text.lower())))
        return None

    def word(self, word: bytes) -> bytes:
        text = unicodedata.normalize("NFC", word.decode("utf-8", "replace"))
        ids = self.plain(text)
        return self.library(text) if ids is None else ids

    def __call__(self, text: bytes) -> bytes:
        whole = text.decode("utf-8", "replace")
        if not self.fast:
            return self.library(whole)
        ids = self.plain(whole)
        return b"".join(map(self.word, text.split())) if ids is None else ids

    def rest(self) -> None:
        """Gives the caches back, at the end of a task."""
        self.pieces.drop()


def encoder_for(path: str) -> Encoder:
    """One encoder for each Python worker and tokenizer file; its caches last for a task."""
    kept = sys.modules.setdefault("_winnow_encoders", types.ModuleType("_winnow_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


# ---------------------------------------------------------------- Re-Pair


def _frequent(keys: np.ndarray, least: int, most: int) -> np.ndarray:
    """The keys that occur at least `least` times, the `most` commonest of them, sorted."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    n = np.diff(at)
    pick = np.flatnonzero(n >= least)
    if len(pick) > most:
        pick = pick[np.argsort(-n[pick], kind="stable")[:most]]
    return np.sort(keys[at[pick]])


def repair(ids: np.ndarray, doc_first: np.ndarray, base: int, per_round: int = 4096, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, symbols before each document, left sides, right sides).

    Each round counts all pairs of neighbours within documents and replaces the `per_round` commonest of them, from left
    to right without overlap, by new nonterminals.  Rounds go on until no pair occurs `least` times: a rule takes
    12 bytes or more in the file and each use saves one symbol of 2 or 4, so rarer pairs hardly pay.  A rule can stand for
    any number of ids.
    """
    width, kind = 16, np.uint32
    seq = ids.astype(kind)
    last = np.zeros(len(seq), dtype=bool)
    ends = doc_first[1:][np.diff(doc_first) > 0]
    last[ends - 1] = True
    lefts, rights, rules = [], [], 0
    while len(seq) > 1:
        if width == 16 and base + rules + per_round > 1 << 16:
            width, kind = 32, np.uint64
            seq = seq.astype(kind)
        keys = (seq[:-1] << kind(width)) | seq[1:]
        inside = ~last[:-1]
        chosen = _frequent(keys[inside], least, per_round)
        if not len(chosen):
            break
        fold = lambda k: ((k * kind(0x9E3779B1)) & kind(0xFFFFFFFF)) >> kind(12)
        sieve = np.zeros(1 << 20, dtype=bool)
        sieve[fold(chosen)] = True
        at = np.flatnonzero(sieve[fold(keys)] & inside)
        rule = np.minimum(np.searchsorted(chosen, keys[at]), len(chosen) - 1)
        ok = chosen[rule] == keys[at]
        at, rule = at[ok], rule[ok]
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(np.concatenate(([True], at[1:] != at[:-1] + 1)), np.arange(len(at)), 0))
        at, rule = at[run % 2 == 0], rule[run % 2 == 0]
        seq[at] = (base + rules + rule).astype(kind)
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        last[at] |= last[at + 1]
        seq, last = seq[keep], last[keep]
        lefts.append((chosen >> kind(width)).astype(np.int64))
        rights.append((chosen & kind((1 << width) - 1)).astype(np.int64))
        rules += len(chosen)
    full = np.diff(doc_first) > 0
    counts = np.zeros(len(full), dtype=np.int64)
    counts[full] = np.diff(np.concatenate(([0], np.flatnonzero(last) + 1)))
    none = np.zeros(0, np.int64)
    return seq, np.concatenate(([0], np.cumsum(counts))), np.concatenate(lefts) if lefts else none, np.concatenate(rights) if rights else none


def pack(doc_ids: pa.Array, ids: np.ndarray, doc_first: np.ndarray, base: int) -> bytes:
    seq, at, left, right = repair(ids, doc_first, base)
    lengths = np.ones(base + len(left), dtype=np.int64)
    for r, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        lengths[base + r] = lengths[a] + lengths[b]
    kind = np.dtype("<u2") if base + len(left) <= 1 << 16 else np.dtype("<u4")
    head = np.array([len(doc_ids), len(left), len(seq), kind.itemsize, base, 0], dtype="<i8")
    nulls = doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    own = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    parts = [head, own, nulls, at.astype("<i8"), doc_first.astype("<i8"), lengths[base:].astype("<i8"), left.astype(kind), right.astype(kind), seq.astype(kind)]
    return MAGIC + b"".join(x.tobytes() for x in parts)


class Shard:
    """Random access to a payload."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a token shard")
        docs, rules, symbols, width, self.base, _ = np.frombuffer(payload, "<i8", 6, 8).tolist()
        at = 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(payload, kind, n, at)
            at += x.nbytes
            return x

        self.doc_ids, self.nulls = take("<i8", docs), take("u1", docs)
        self.symbols_before, self.tokens_before = take("<i8", docs + 1), take("<i8", docs + 1)
        self.lengths = take("<i8", rules)
        sides = f"<u{width}"
        self.left, self.right, self.seq = take(sides, rules), take(sides, rules), take(sides, symbols)

    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all rules, first of each rule)."""
        first = np.concatenate(([0], np.cumsum(self.lengths)))
        flat = np.zeros(int(first[-1]), dtype=np.uint32)
        spots = first.tolist()
        for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
            i = spots[r]
            for x in (a, b):
                if x < self.base:
                    flat[i] = x
                    i += 1
                else:
                    k = x - self.base
                    n = spots[k + 1] - spots[k]
                    flat[i : i + n] = flat[spots[k] : spots[k] + n]
                    i += n
        return flat, first

    def ids(self) -> np.ndarray:
        """The ids of all documents, as uint32."""
        flat, first = self.expansions()
        flat = np.concatenate((np.arange(self.base, dtype=np.uint32), flat))
        where = np.concatenate((np.arange(self.base), self.base + first[:-1]))
        n = np.concatenate((np.ones(self.base, np.int64), self.lengths))[self.seq]
        out = np.cumsum(n)
        return flat[np.repeat(where[self.seq] - out + n, n) + np.arange(int(out[-1]) if len(out) else 0)]

    def _expand(self, symbol: int) -> list[int]:
        todo, out = [symbol], []
        while todo:
            x = todo.pop()
            if x < self.base:
                out.append(x)
            else:
                todo += [int(self.right[x - self.base]), int(self.left[x - self.base])]
        return out

    def slice(self, k: int, start: int, stop: int) -> list[int]:
        """Ids start..stop of document k, from the symbols that hold them only."""
        own = self.seq[self.symbols_before[k] : self.symbols_before[k + 1]].astype(np.int64)
        n = np.concatenate((np.ones(self.base, np.int64), self.lengths))[own]
        ends = np.cumsum(n)
        i, j = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
        ids = [x for s in own[i : j + 1].tolist() for x in self._expand(s)]
        skip = start - int(ends[i] - n[i]) if i < len(own) else 0
        return ids[skip : skip + max(0, min(stop, int(ends[-1]) if len(ends) else 0) - start)]


# ---------------------------------------------------------------- files


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_shards(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, part_bytes: int = PART_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows (part, shard, first_token, tokens, payload) of all texts, in ascending order of an integer id (null first).

    A null text is empty; rows with equal ids stay, in order of a hash of their texts; other columns, whatever their
    names, are not read.  A document of any length is encoded whole, one over `shard_bytes` in a shard of its own.  No
    rows: no shards.
    """
    path = tokenizer or default_tokenizer()
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*")).first()[0]
    parts = max(1, math.ceil(size / part_bytes))
    order = ["id", F.xxhash64("text")]
    dealt = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order) if parts > 1 else slim.coalesce(1).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_for(path)
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            b, off = text_bytes(batch.column(1))
            for i, j in slices(off, shard_bytes):
                found = [encode(b[off[x] : off[x + 1]].tobytes()) + end for x in range(i, j)]
                first = np.concatenate(([0], np.cumsum([len(x) for x in found]))) // encode.dtype.itemsize
                ids = np.frombuffer(b"".join(found), dtype=encode.dtype)
                payload = pack(batch.column(0).slice(i, j - i), ids, first, encode.size)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], names=["part", "shard", "first_token", "tokens", "payload"])
                shard, before = shard + 1, before + len(ids)
        encode.rest()

    return map_batches(dealt, run, "part bigint, shard bigint, first_token bigint, tokens bigint, payload binary")


def read_documents(shards: DataFrame, broadcast_parts: int = 200_000) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a table written from encode_shards."""
    sums = shards.groupBy("part").agg(F.sum("tokens").alias("n"))
    base = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = shards.join(F.broadcast(base) if sums.count() <= broadcast_parts else base, "part").select((F.col("base") + F.col("first_token")).alias("before"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = Shard(payload.as_py())
                data, at = memoryview(own.ids().astype("<u4").tobytes()), own.tokens_before
                crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(own.doc_ids, pa.int64(), mask=own.nulls.astype(bool)), pa.array(before + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(placed, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op4_token_ids(spark, sf_dir: str) -> DataFrame:
    """Every document written as token ids and read back.  A null or empty text has its end id only; equal ids keep all
    their rows, in order of a hash of their texts; an empty table gives no rows; other columns are not read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_documents(scratch(encode_shards(docs), "tokens"))
