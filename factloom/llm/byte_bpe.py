"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding cuts texts into pre-tokens with numpy (classes of code points, no regular expression per
word), numbers the distinct ones of a chunk of texts, and sends them to the tasks that own them by hash,
packed into a row for each chunk and owner. There every distinct word is merged once; its ids go
back to the chunk, where texts are put together from their word numbers in order. Texts themselves
are never shuffled, only their compressed word numbers, once. A word arrives once per chunk however
often it is used, so frequent words don't make large tasks. Decoding joins ids with the table of token bytes,
which the vocabulary bounds.

Defined cases: null or empty text has no ids and decodes to nothing; a null doc_id stays null;
repeated rows are encoded one by one; an empty table gives an empty result. Columns other than
the id and the text are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import Hasher, flat, frugal, mix, ranges, slices
from .staging import partitions

#: Text bytes of a chunk, which shares one list of distinct words.
CHUNK_BYTES = 24 << 20
#: Distinct words that a task remembers before it starts anew.
MEMO_WORDS = 1 << 18
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point as the pattern sees it."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    out = np.full(0x110000, _OTHER, np.uint8)
    for k, pat in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pat, every):
            out[points[m.start() : m.end()]] = k
    return out


def pre_tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where the pattern's matches start, and match offsets per text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    kind, n = classes()[points], len(points)
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(at, offs)] = True  # the first character of each text
    head = head[:n]
    last = np.append(head[1:], True)
    fresh = head | np.append(True, kind[1:] != kind[:-1])
    space = kind == _SPACE
    start = fresh.copy()
    # White space: all but the last character of a run that something follows is one match; a plain
    # last space belongs to what follows, another last character stands alone.
    ahead = np.append(~space[1:] & ~last[:-1], False) if n > 1 else np.zeros(n, bool)
    tail = space & ahead
    start[tail] = True
    plain = tail & (points == 0x20)
    joined = np.flatnonzero(plain) + 1
    start[joined] = False
    # Contractions, where a match would start at the apostrophe.
    mark = np.flatnonzero((points == 0x27) & start)
    if len(mark):
        padded = np.append(points, np.zeros(3, np.uint32))
        edge = np.append(head, [True, True, True])
        one, two = padded[mark + 1], padded[mark + 2]
        in1 = ~edge[mark + 1]
        in2 = in1 & ~edge[mark + 2]
        s = in1 & np.isin(one, [ord(c) for c in "stmd"])
        d = in2 & ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for hit, size in ((mark[s], 2), (mark[d & ~s], 3)):
            start[hit + 1] = False
            hit = hit[hit + size < n]
            start[hit + size] = True
    starts = at[start]
    return starts, np.searchsorted(starts, offs)


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and where each id's start and how many there are."""
    by_id = {i: b for b, i in ranks(path).items()}
    words = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    lens = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lens) - lens, lens


_WORDS, _TEXTS = 0, 1
_FLOW = "chunk long, kind int, owner int, seq long, words binary, sizes binary, places binary, doc_ids array<{id}>"


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


class _Chunk:
    """Texts of one task that share a list of distinct words. It is named by its content, so that words
    and texts, which are cut in separate passes, find each other."""

    def __init__(self):
        self.seen: dict[int, int] = {}
        self.words: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.texts: list[tuple[pa.Array, np.ndarray, bytes]] = []
        self.name, self.size = hashlib.blake2b(digest_size=8), 0

    def add(self, b: pa.RecordBatch, with_texts: bool) -> None:
        data, offs = flat(b.column("text"))
        starts, per = pre_tokens(data, offs)
        ends = np.append(starts[1:], len(data))
        keys, first, back = np.unique(Hasher(data)(starts, ends), return_index=True, return_inverse=True)
        seen, listed = self.seen, keys.tolist()
        new = [k for k in np.argsort(first).tolist() if listed[k] not in seen]
        if new:
            seen.update(zip(keys[new].tolist(), range(len(seen), len(seen) + len(new))))
            lens = (ends - starts)[first[new]]
            self.words.append((keys[new], lens, data[ranges(starts[first[new]], lens)] if not with_texts else None))
        sizes = np.diff(per).astype(np.int64)
        self.name.update(sizes.tobytes() + keys[new].tobytes())
        self.size += len(data)
        if with_texts:
            number = np.fromiter((seen[h] for h in listed), np.uint32, len(keys))[back] if len(keys) else np.zeros(0, np.uint32)
            self.texts.append((b.column("doc_id"), sizes, _pack(number)))

    def id(self) -> int:
        return int.from_bytes(self.name.digest(), "little", signed=True)

    def word_rows(self, owners: int, names: list[str], id_type: pa.DataType) -> pa.RecordBatch | None:
        """A row for each task that owns some of the words: the words, their lengths, their numbers."""
        if not self.words:
            return None
        keys, lens, data = (np.concatenate([w[i] for w in self.words]) for i in range(3))
        owner = (mix(keys) % np.uint64(owners)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(owner[order]) != 0))
        start = np.cumsum(lens) - lens
        words, sizes, places = [], [], []
        for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(order)]):
            own = order[i:j]
            words.append(_pack(data[ranges(start[own], lens[own])]))
            sizes.append(_pack(lens[own].astype(np.uint32)))
            places.append(_pack(np.diff(own, prepend=0).astype(np.uint32)))
        n = len(edge)
        counts = np.diff(np.append(edge, len(order)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, self.id())), pa.array(np.full(n, _WORDS), pa.int32()), pa.array(owner[order][edge], pa.int32()), pa.array(counts), pa.array(words, pa.binary()), pa.array(sizes, pa.binary()), pa.array(places, pa.binary()), pa.nulls(n, pa.list_(id_type))], names=names)

    def text_rows(self, names: list[str]):
        for k, (ids, sizes, packed) in enumerate(self.texts):
            yield pa.RecordBatch.from_arrays([pa.array([self.id()]), pa.array([_TEXTS], pa.int32()), pa.array([len(self.seen)], pa.int32()), pa.array([k]), pa.array([packed], pa.binary()), pa.array([sizes.tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], names=names)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, ids (array of int): tiktoken's encode_ordinary of each text. docs is read twice and must
    come in the same partitions both times, as tables do; otherwise the job fails, never the result."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    id_type = src.schema["doc_id"].dataType
    flow = T._parse_datatype_string(_FLOW.format(id=id_type.simpleString()))
    names, n = flow.fieldNames(), partitions(docs.sparkSession)
    kind_of = np.uint16 if len(ranks(ranks_path)) <= 1 << 16 else np.uint32

    def cut(with_texts: bool):
        def run(batches):
            chunk = _Chunk()

            def close():
                if with_texts:
                    yield from chunk.text_rows(names)
                elif (rows := chunk.word_rows(n, names, doc_type)) is not None:
                    for i in range(0, rows.num_rows, 500):
                        yield rows.slice(i, 500)

            doc_type = None
            for batch in batches:
                doc_type = batch.column("doc_id").type
                for b in slices(batch, "text"):
                    if chunk.size > chunk_bytes:
                        yield from close()
                        chunk = _Chunk()
                    chunk.add(b, with_texts)
            if chunk.size or chunk.texts:
                yield from close()

        return run

    def merge(batches):
        """Each distinct word of a task once; its ids take the place of the word."""
        one = encoder(ranks_path, pattern)._encode_single_piece
        memo: dict[bytes, bytes] = {}
        for b in batches:
            ids_col, lens_col = [], []
            for count, words, sizes in zip(b.column("seq").to_pylist(), b.column("words").to_pylist(), b.column("sizes").to_pylist()):
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                ends = np.cumsum(_unpack(sizes, np.uint32, count).astype(np.int64)).tolist()
                raw = _unpack(words, np.uint8, ends[-1]).tobytes()
                out = []
                for i, j in zip([0, *ends], ends):
                    w = raw[i:j]
                    ids = memo.get(w)
                    if ids is None:
                        ids = memo[w] = np.array(one(w), kind_of).tobytes()
                    out.append(ids)
                lens = np.fromiter(map(len, out), np.int64, len(out)) // np.dtype(kind_of).itemsize
                ids_col.append(_pack(np.frombuffer(b"".join(out), kind_of)))
                lens_col.append(_pack(lens.astype(np.uint32)))
            yield b.set_column(4, "words", pa.array(ids_col, pa.binary())).set_column(5, "sizes", pa.array(lens_col, pa.binary()))

    result = T.StructType().add("doc_id", id_type).add("ids", T.ArrayType(T.IntegerType()))

    def rebuild(batches):
        now, lists, table = None, [], None
        for b in batches:
            for k in range(b.num_rows):  # a row's payloads at a time
                chunk, kind, owner, seq, words, sizes, places = (b.column(c)[k].as_py() for c in names[:-1])
                ids = b.column("doc_ids")[k]
                if chunk != now:
                    now, lists, table = chunk, [], None
                if kind == _WORDS:
                    lens = _unpack(sizes, np.uint32, seq).astype(np.int64)
                    lists.append((np.cumsum(_unpack(places, np.uint32, seq).astype(np.int64)), lens, _unpack(words, kind_of, int(lens.sum()))))
                    continue
                if table is None:
                    table = _table_of(lists, owner, kind_of)
                    lists = []
                pool, starts, lens = table
                sizes = np.frombuffer(sizes, np.int64)
                number = _unpack(words, np.uint32, int(sizes.sum())).astype(np.int64)
                each = lens[number]
                edge = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)])]
                yield pa.RecordBatch.from_arrays([ids.values, pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(pool[ranges(starts[number], each)].astype(np.int32)))], names=result.fieldNames())

    encoded = src.mapInArrow(frugal(cut(False)), flow).repartitionById(n, F.col("owner")).mapInArrow(frugal(merge), flow)
    back = encoded.union(src.mapInArrow(frugal(cut(True)), flow)).repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "seq")
    return back.mapInArrow(frugal(rebuild), result)


def _table_of(lists: list[tuple], words: int, kind_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a chunk's words, and where each word's start and how many there are."""
    lens, starts = np.full(words, -1, np.int64), np.zeros(words, np.int64)
    at = 0
    for place, each, ids in lists:
        lens[place], starts[place] = each, at + np.cumsum(each) - each
        at += len(ids)
    if (lens < 0).any():
        raise RuntimeError("the documents came in other partitions the second time; encode a written table")
    return np.concatenate([x[2] for x in lists]) if lists else np.zeros(0, kind_of), starts, lens


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, text_bytes (binary) of doc_id, ids."""
    out = T.StructType().add(encoded.schema["doc_id"]).add("text_bytes", T.BinaryType())

    def run(batches):
        for b in batches:
            for part in _by_ids(b):
                ids, edge = _ids(part)
                data, offs = spell(ids, edge, ranks_path)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data)])], names=out.fieldNames())

    return encoded.select("doc_id", "ids").mapInArrow(frugal(run), out)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    a = batch.column("ids")
    edge = np.concatenate([[0], np.cumsum(np.asarray(a.value_lengths().fill_null(0), np.int64))])
    return np.asarray(a.flatten(), np.int64), edge


def _by_ids(batch: pa.RecordBatch, limit: int = 1 << 18):
    _, edge = _ids(batch)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def spell(ids: np.ndarray, edge: np.ndarray, ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids by the token-byte table, and byte offsets per text."""
    table, starts, lens = token_bytes(ranks_path)
    each = lens[ids]
    return table[ranges(starts[ids], each)], np.concatenate([[0], np.cumsum(each)])[edge]


@functools.lru_cache(maxsize=2)
def _decimals(n: int) -> list[bytes]:
    return [b"%d" % i for i in range(n)]


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what a reader needs to compare two encodings."""
    out = T.StructType().add(encoded.schema["doc_id"]).add("n_tokens", T.LongType()).add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())

    def run(batches):
        word = _decimals(len(token_bytes(ranks_path)[1]))
        for b in batches:
            for part in _by_ids(b):
                ids, edge = _ids(part)
                data, offs = spell(ids, edge, ranks_path)
                raw, cuts, listed = memoryview(data), offs.tolist(), ids.tolist()
                e = edge.tolist()
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(np.diff(edge)),
                    pa.array([hashlib.sha256(b" ".join([word[k] for k in listed[i:j]])).hexdigest() for i, j in zip(e, e[1:])], pa.string()),
                    pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(cuts, cuts[1:])], pa.string()),
                ], names=out.fieldNames())

    return encoded.select("doc_id", "ids").mapInArrow(frugal(run), out)
