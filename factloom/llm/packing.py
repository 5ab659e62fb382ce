"""Packing of tokenised documents into fixed windows by best-fit decreasing.

Tokens: texts are cut at ASCII white space and between an ASCII letter and a comma or point, and
each distinct run is tokenised once per task, in ASCII lower case (the tokenizer drops white
space, always splits there, and lower-cases), so it sees the vocabulary and not the text. Strings of
added tokens keep their case, for the tokenizer knows them by it, and give their own ids. Packing is a map: each task
packs what its input split holds, so nothing is shuffled, and a lost task is simply run again
with the same result. Padding comes from the last few windows of a group only. A task holds the pieces
of one group, and their ids only where these are asked for, so its memory is bounded; a longer text than
GROUP_IDS is a group by itself.

Defined cases: null or empty text is the end-of-document id alone; a null doc_id stays null;
repeated rows are packed as documents of their own; an empty table gives an empty result.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import LOWER, Hasher, flat, frugal, ranges, slices, spans

WINDOW = 2048
END_ID = 1
#: A task packs at most so many pieces at once, and with ids so many ids; beyond that it starts a new group.
GROUP_PIECES, GROUP_IDS = 1 << 18, 1 << 21
#: Distinct runs that a task remembers before it starts anew.
MEMO_RUNS = 1 << 18
#: Text bytes that are tokenised at once, and rows and ids of an output batch.
SLICE_BYTES = 1 << 18
BATCH_ROWS, BATCH_IDS = 10_000, 1 << 18


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of counts over the capacities."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window_id: int) -> None:
        if not capacity:
            return
        self.at[capacity].append(window_id)
        i = capacity + self.size
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (window, capacity) of the tightest window that holds `need`."""
        tree, i = self.tree, need + self.size
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            tree[i] -= 1
            i >>= 1
        return self.at[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece (1 to `window` long); ties keep their order."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == window).sum())
    where[order[:full]] = np.arange(full)
    windows, count = OpenWindows(window), full
    for k in order[full:].tolist():
        need = int(lengths[k])
        found = windows.take(need)
        if found:
            w, capacity = found
        else:
            w, capacity, count = count, window, count + 1
        where[k], offset[k] = w, window - capacity
        windows.add(capacity - need, w)
    return where, offset


#: Runs that are joined into one call of the tokenizer.
JOINED_RUNS = 512


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    assert not any(set(a.content) & set(" \t\n\x0b\x0c\r,.") or a.normalized or a.single_word for a in t.get_added_tokens_decoder().values())  # none is cut or found elsewhere
    return t


@functools.lru_cache(maxsize=2)
def added(path: str) -> list[bytes]:
    """Strings of added tokens in ASCII lower case."""
    return [bytes(LOWER[np.frombuffer(a.content.encode(), np.uint8)]) for a in tokenizer(path).get_added_tokens_decoder().values()]


def lowered(path: str, data: np.ndarray) -> np.ndarray:
    """data in ASCII lower case, but for what would read as an added token in it."""
    out = LOWER[data]
    raw = out.tobytes()
    for token in added(path):
        at = raw.find(token)
        while at >= 0:
            out[at : at + len(token)] = data[at : at + len(token)]
            at = raw.find(token, at + 1)
    return out


@functools.lru_cache(maxsize=2)
def bare(path: str):
    """The tokenizer's merges alone, for words that its normaliser and splitter leave whole; which ids end a word."""
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer(tokenizer(path).model)
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = tokenizer(path).get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
    return t, ends


def whole(run: str) -> bool:
    """Lower-case Latin letters in composed form: one word to the splitter, unchanged by the normaliser."""
    return run.isalpha() and (run.isascii() or max(run) < "\u0250" and run == run.lower())


def encode_runs(path: str, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all runs, one after the other, and their number per run."""
    easy = np.fromiter(map(whole, runs), bool, len(runs))
    words = [r for r, ok in zip(runs, easy.tolist()) if ok]
    merges, ends = bare(path)
    joined = merges.encode_batch_fast([" ".join(words[i : i + JOINED_RUNS]) for i in range(0, len(words), JOINED_RUNS)], add_special_tokens=False)
    ids = [np.array(e.ids, np.uint32) for e in joined]
    fast = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    edge = np.concatenate([[0], np.flatnonzero(ends[fast]) + 1])
    assert len(edge) == len(words) + 1
    rest = [e.ids for e in tokenizer(path).encode_batch_fast([r for r, ok in zip(runs, easy.tolist()) if not ok], add_special_tokens=False)]
    lens, starts = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
    lens[easy], starts[easy] = np.diff(edge), edge[:-1]
    lens[~easy] = np.fromiter(map(len, rest), np.int64, len(rest))
    starts[~easy] = len(fast) + np.cumsum(lens[~easy]) - lens[~easy]
    pool = np.concatenate([fast, np.fromiter((x for e in rest for x in e), np.uint32, int(lens[~easy].sum()))])
    return pool[ranges(starts, lens)], lens


LETTER, POINT = np.zeros(256, bool), np.zeros(256, bool)
LETTER[97:123] = True
POINT[[0x2C, 0x2E]] = True


class RunEncoder:
    """Token ids of texts through a memory of distinct runs. Slot 0 is the end-of-document id."""

    def __init__(self, path: str, end_id: int):
        self.path, self.end_id = path, end_id
        self.reset()

    def reset(self) -> None:
        self.slots: dict[int, int] = {}
        self.pool, self.starts, self.lens = np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each text closed by the end id; lengths per text."""
        if len(self.slots) > MEMO_RUNS:
            self.reset()
        data = lowered(self.path, data)
        letter, point = LETTER[data], POINT[data]
        cuts = np.zeros(len(data), bool)
        cuts[1:] = letter[:-1] & point[1:] | point[:-1] & letter[1:]
        starts, ends, at = spans(data, offs, cuts)
        keys, first, back = np.unique(Hasher(data)(starts, ends), return_index=True, return_inverse=True)
        known = self.slots
        new = [k for k, h in enumerate(keys.tolist()) if h not in known]
        if new:
            raw, a, b = data.tobytes(), starts[first[new]].tolist(), ends[first[new]].tolist()
            ids, lens = encode_runs(self.path, [raw[i:j].decode() for i, j in zip(a, b)])
            base = len(self.lens)
            self.starts = np.append(self.starts, len(self.pool) + np.cumsum(lens) - lens)
            self.lens = np.append(self.lens, lens)
            self.pool = np.append(self.pool, ids)
            known.update(zip(keys[new].tolist(), range(base, base + len(new))))
        slot = np.fromiter((known[h] for h in keys.tolist()), np.int64, len(keys))[back] if len(keys) else np.zeros(0, np.int64)
        slot = np.insert(slot, at[1:], 0)
        lens = self.lens[slot]
        ids = self.pool[ranges(self.starts[slot], lens)]
        edge = np.concatenate([[0], np.cumsum(lens)])
        return ids, np.diff(edge[at + np.arange(len(at))])


def schema(id_type: T.DataType, with_ids: bool) -> T.StructType:
    s = T.StructType().add("doc_id", id_type)
    for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        s = s.add(c, T.LongType())
    return s.add("ids", T.ArrayType(T.IntegerType())) if with_ids else s


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    with_ids, the ids themselves. A sequence is the pieces of one sequence_id by offset."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = schema(src.schema["doc_id"].dataType, with_ids)

    def run(batches):
        encode = RunEncoder(tokenizer_path, end_id)
        part, done = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        pieces = tokens = 0

        def flush():
            nonlocal done, held, pieces, tokens
            doc = pa.concat_arrays([h[0] for h in held])
            cols = [np.concatenate([h[k] for h in held]) for k in (1, 2, 3, 4)]
            where, offset = best_fit_decreasing(cols[1], window)
            arrays = [doc, *cols, (part << 32) + done + where, offset]
            edge = np.concatenate([[0], np.cumsum(cols[1])])
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate([h[5] for h in held]).view(np.int32))))
            table = pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, pa.int64()) for a in arrays], names=out.fieldNames())
            done, held, pieces, tokens = done + int(where.max(initial=-1)) + 1, [], 0, 0
            i = 0
            while i < table.num_rows:
                j = max(i + 1, int(np.searchsorted(edge, edge[i] + BATCH_IDS, "right")) - 1) if with_ids else i + BATCH_ROWS
                j = min(j, i + BATCH_ROWS)
                yield table.slice(i, j - i)
                i = j

        for batch in batches:
            for b in slices(batch, "text", SLICE_BYTES):
                ids, lens = encode(*flat(b.column("text")))
                n = -(-lens // window)
                row = np.repeat(np.arange(len(lens)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(window, lens[row] - start)
                at = (np.cumsum(lens) - lens)[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at.tolist(), (at + length).tolist())), np.int64, len(row))
                held.append((b.column("doc_id").take(pa.array(row)), start, length, crc, lens[row], ids if with_ids else None))
                pieces, tokens = pieces + len(row), tokens + len(ids)
                if pieces >= GROUP_PIECES or with_ids and tokens >= GROUP_IDS:
                    yield from flush()
        if held:
            yield from flush()

    return src.mapInArrow(frugal(run), out)
