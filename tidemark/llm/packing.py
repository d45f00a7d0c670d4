"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

``pieces`` tokenises whole texts: a text is cut at ASCII white space and behind words, where no token of the vocabulary
crosses, so that each chunk is encoded once and then found in a bounded cache. ``assign`` places pieces by bounded-space online
best-fit: at most ``open_bins`` sequences are open, a bitset keyed by their free space gives the tightest one that
fits in a shift and a mask, and where a new one is needed beyond the bound the fullest closes first.
"""

from __future__ import annotations

import codecs
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, materialise

CAPACITY = 4096
END_ID = 1
#: Chunks kept in each of the cache's two generations; longer chunks are not kept.
CACHE_CHUNKS, CACHE_BYTES = 400_000, 64
_ID = struct.Struct("<I").pack
#: The character that stands for each byte: itself if it is printable Latin-1, else the next from U+0100.
_SHOWN = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
_BYTE_CHARACTERS = [chr(b) if b in _SHOWN else chr(256 + sum(c not in _SHOWN for c in range(b))) for b in range(256)]
_SHOWN_AND_SPACE = "".join(" " if b == 32 else c for b, c in enumerate(_BYTE_CHARACTERS))
#: Of each byte: 1 for a letter a-z, 2 for what is ASCII and neither letter nor white space, 3 for what may begin a mark
#: (U+0300 and above), else 0.
_KIND = bytes(1 if bytes([b]).islower() else 3 if b >= 0xCC else 2 if b < 128 and not bytes([b]).isspace() and not bytes([b]).isalpha() else 0 for b in range(256))
_NO_LETTER = bytes(b for b in range(128) if not bytes([b]).isalpha())
_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, through a cache of white-space chunks.

    A batch is cut into chunks and put together again by Arrow; Python sees its distinct chunks only.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model for words that need no more preparation than a cut at spaces.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix, vocabulary = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        #: By id, whether a word ends with it; None if the model's tokens don't tell.
        self.last = None
        if suffix:
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes | None] | pa.Array) -> list[bytes]:
        """The ids of each text, without an end."""
        column = pa.array(texts, pa.large_binary()) if isinstance(texts, list) else texts.cast(pa.large_binary())
        if not len(column):
            return []
        chunks = pc.ascii_split_whitespace(spaced(column.fill_null(b"")))
        distinct = chunks.values.dictionary_encode()
        ids = pa.array(self._learn(distinct.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        joined = ids.take(distinct.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)[chunks.offsets.to_numpy()].tolist()
        data = memoryview(joined.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks; a new one is encoded as the core and the tail it splits into."""
        if len(self.young) > CACHE_CHUNKS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, chunks))
        fresh = [at for at, ids in enumerate(out) if ids is None]
        words: list[bytes] = []
        others: dict[bytes, bytes | None] = {}
        made: list[tuple[bytes, tuple[bytes, ...]]] = []
        now: dict[bytes, bytes] = {}
        for w in [chunks[at] for at in fresh]:
            if (ids := old.get(w)) is not None:
                now[w] = ids
            elif self.last is not None and w.isalpha() and w.islower():  # ASCII
                words.append(w)
            else:
                made.append((w, parts := split(w)))
                for x in parts:
                    others[x] = young.get(x, old.get(x))
        now.update(zip(words, self._words(words)))
        new = [x for x, ids in others.items() if ids is None and x not in now]
        words = [x for x in new if is_word(x)] if self.last is not None else []
        now.update(zip(words, self._words(words)))
        new = [x for x in new if x not in now]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for x, e in zip(some, self.tokenizer.encode_batch_fast([x.decode("utf-8") for x in some], add_special_tokens=False)):
                now[x] = b"".join(map(_ID, e.ids))
        for w, parts in made:
            if w not in now:
                now[w] = b"".join([now[x] if x in now else others[x] for x in parts])
        for at in fresh:
            out[at] = now[chunks[at]]
        young.update(now if max(map(len, now), default=0) <= CACHE_BYTES else {x: ids for x, ids in now.items() if len(x) <= CACHE_BYTES})
        return out

    def _words(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of each word of ``is_word``; many are one text to the model."""
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            shown = codecs.charmap_decode(b" ".join(some), "strict", _SHOWN_AND_SPACE)[0]
            ids = np.array(self.words.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) != len(some):
                raise ValueError("the model gave a word no end, or several")
            data = ids.tobytes()
            yield from (data[a:b] for a, b in zip([0, *ends], ends))


def spaced(texts: pa.LargeBinaryArray) -> pa.LargeStringArray:
    """Texts (none null) in lower-case A-Z, with a space after each run of letters that ends in A-Z before another ASCII
    character: the tokenizer ends it there as well. Texts that may hold a special token stay as they are, and so do
    letters before what may be a mark: the tokenizer composes before it lower-cases, and not all have both cases."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]])
    offsets = offsets - offsets[0]
    data = raw.lower()
    before, new = np.frombuffer(raw, np.uint8), np.array(np.frombuffer(data, np.uint8))
    kind = np.frombuffer(data.translate(_KIND), np.uint8)
    letter = kind[:-1] == 1
    at, marked = np.flatnonzero(letter & (kind[1:] == 2)) + 1, np.flatnonzero(letter & (kind[1:] == 3))
    new[marked] = before[marked]
    if b"<|" in raw:
        kept = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        at = at[~kept[np.searchsorted(offsets, at, "right") - 1]]
        new = np.where(np.repeat(kept, np.diff(offsets)), before, new)
    # a space between two texts is white space at the end of the first
    ends = offsets + np.searchsorted(at, offsets, "right")
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(np.insert(new, at, 32)))


def is_word(x: bytes) -> bool:
    """Whether a chunk is one run of lower-case Latin letters, whose byte characters the model takes as they are."""
    if x.isalpha():  # ASCII
        return x.islower()
    s = x.decode("utf-8")
    return s.isalpha() and s == s.lower() and max(s) < "\u0250"


def split(w: bytes) -> tuple[bytes, ...]:
    """Parts of a white-space chunk that the tokenizer takes alike alone: a run of letters ends where something else
    begins. Chunks that may hold a special token stay as they are."""
    core = w.rstrip(_NO_LETTER)
    if core == w or not core or b"<|" in w:
        return (w,)
    if core[-1] >= 128:
        last = core.decode("utf-8")[-1]
        if ord(last) >= 0x250 or not last.lower().isalpha():  # İ becomes an i and a mark
            return (w,)
    return core, w[len(core) :]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece int, start long, length long, ids binary (little-endian uint32).

    A document is its ids and one end id. Null and empty texts are the end id alone. Only documents longer than
    ``capacity`` are cut; the last piece may be shorter. Repeated rows give their pieces again; ids may be null.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], dtype="<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, piece, start, ids = [], [], [], []
                for i, x in enumerate(_encoders[path].encode(part.column(1))):
                    x += end
                    for k, a in enumerate(range(0, len(x), 4 * capacity)):
                        row.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        ids.append(x[a : a + 4 * capacity])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


class BestFit:
    """Bounded-space online best-fit over one stream of lengths."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0) -> None:
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.free = 0  # bit f: an open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        fits = self.free >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            at = self._take(f)
        else:
            if self.count >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            f, at = self.capacity, self.next
            self.next += 1
        if left := f - length:
            self.bins[left].append(at)
            self.free |= 1 << left
            self.count += 1
        return at, self.capacity - f

    def _take(self, f: int) -> int:
        at = self.bins[f].pop()
        if not self.bins[f]:
            self.free ^= 1 << f
        self.count -= 1
        return at


def assign(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = 1024, pieces_per_task: int = 131_072) -> DataFrame:
    """``parts`` (doc_id, piece, length, ...; a written table) with sequence_id long and offset long.

    Pieces are dealt by a hash of their key to one stream per ``pieces_per_task`` and placed in the order of that
    hash, so reruns agree and each stream sees the same mix of lengths. What streams leave open is at most
    ``open_bins`` sequences each.
    """
    tasks = max(1, -(-parts.count() // pieces_per_task))
    at, names = parts.columns.index("length"), parts.columns
    schema = parts.schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = np.array([fit.place(n) for n in batch.column(at).to_pylist()], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(placed[:, 0].copy()), pa.array(placed[:, 1].copy())], names=[*names, "sequence_id", "offset"])

    dealt = parts.withColumn("_order", F.xxhash64("doc_id", "piece"))
    ordered = dealt.repartition(tasks, "_order").sortWithinPartitions("_order", *[c for c in names if c in ("doc_id", "piece", "length", "ids_crc32")]).drop("_order")
    return ordered.mapInArrow(place, schema.add("sequence_id", "long").add("offset", "long"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, open_bins: int = 1024) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Other columns of ``docs`` are ignored.

    The ids themselves come from ``pieces``; they are reduced to their checksum before anything is written or
    shuffled. An empty table gives an empty result.
    """
    cut = pieces(docs, id_col, text_col, tokenizer, capacity)
    return assign(materialise(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))), capacity, open_bins)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
