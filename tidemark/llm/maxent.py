"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

log10 P(word | history) = log10 P(class | history) + log10 P(slot | class, history) + log10 P(word | slot). Both softmaxes
sum weight rows of a bias, the word before, the class of the word at distance two (a skip feature) and the pair of them
(an n-gram feature, hashed); within a class the rows are hashed with the class. The most frequent words have slots of their own,
where the last factor is one; others share slots by their last two bytes, and there a word has its add-half share of
counts, an unseen word the half of one more. Words that end alike are neighbours, so they fall into one class.

Training takes every token of every training document. Tokens are first counted by (two words before, word), so that a
gradient is worked out once for each distinct history and weighed by its count, however often it occurs. Tasks descend
over their histories from the shared weights, batch by batch as they are read; each weight row then moves by the mean of
the tasks' moves, weighed by the tokens that met that row, summed in a tree of bounded groups.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_of_id, load, materialise, parallelism, utf8

END = b"\n"  # no word holds it
HEAD = 131_072
CLASSES, SLOTS = 64, 64
WORDS = CLASSES * SLOTS
OWN = WORDS - 256  # slots of one word, the others are shared; the first is the end, which also stands before a text
_BITS = 12
_MASK = WORDS - 1
PAIR_ROWS, NEXT_ROWS = 8192, 8192
#: Weight rows of the class softmax: a bias, words at distance one, classes at distance two, hashed pairs.
CLASS_ROWS = 1 + WORDS + CLASSES + PAIR_ROWS
#: Weight rows of the slot softmax: a bias for each class; with the class: words (hashed), classes, pairs (hashed).
SLOT_ROWS = CLASSES + NEXT_ROWS + CLASSES * CLASSES + PAIR_ROWS // 2
ROWS = CLASS_ROWS + SLOT_ROWS
BLOCKS, FAN_IN = 16, 32
TASK_TOKENS = 8_000_000


def shared_slot(word: bytes, own: int = OWN) -> int:
    return own + zlib.crc32(word[-2:]) % (WORDS - own)


def tokens(text: bytes | None) -> list[bytes]:
    """Words, A-Z in lower case, and the end."""
    out = (text or b"").lower().split()
    out.append(END)
    return out


def _hash(key: np.ndarray, salt: int, rows: int) -> np.ndarray:
    return (((key + salt) * 0x9E3779B1) >> 13) % rows


def class_rows(contexts: np.ndarray) -> np.ndarray:
    """(n, 4) weight rows for contexts, which hold the word at distance one above the class of the one before it."""
    a, b = contexts >> 6, contexts & 63
    return np.column_stack([np.zeros(len(a), np.int64), 1 + a, 1 + WORDS + b, 1 + WORDS + CLASSES + _hash(contexts, 1, PAIR_ROWS)])


def slot_rows(contexts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """(n, 4) weight rows for contexts and the class that the slot is in."""
    a, b = contexts >> 6, contexts & 63
    first = CLASS_ROWS + CLASSES
    return np.column_stack(
        [
            CLASS_ROWS + classes,
            first + _hash(a * CLASSES + classes, 2, NEXT_ROWS),
            first + NEXT_ROWS + b * CLASSES + classes,
            first + NEXT_ROWS + CLASSES * CLASSES + _hash(contexts * CLASSES + classes, 4, PAIR_ROWS // 2),
        ]
    )


def history(slots: np.ndarray) -> np.ndarray:
    """The context of each token of one document."""
    padded = np.concatenate([np.zeros(2, np.int64), slots])
    return (padded[1:-1] << 6) | (padded[:-2] >> 6)


def distinct(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The kinds of keys below ``size`` in order, and the place of each key among them."""
    place = np.zeros(size, np.int32)
    place[keys] = 1
    kinds = np.flatnonzero(place)
    place[kinds] = np.arange(len(kinds), dtype=np.int32)
    return kinds, place[keys]


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        z += weights[rows[:, k]]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def score_slots(weights: np.ndarray, contexts: np.ndarray, slots: np.ndarray, batch: int = 65_536) -> np.ndarray:
    """Natural log probabilities of slots; equal contexts in a batch are worked out once."""
    out = np.empty(len(slots))
    for at in range(0, len(slots), batch):
        own, which = contexts[at : at + batch], slots[at : at + batch]
        kinds, back = distinct(own, WORDS * CLASSES)
        classes = which >> 6
        got = log_softmax(weights, class_rows(kinds))[back, classes].astype(np.float64)
        pairs, again = distinct(back * CLASSES + classes, len(kinds) * CLASSES)
        logs = log_softmax(weights, slot_rows(kinds[pairs // CLASSES], pairs % CLASSES))
        out[at : at + batch] = got + logs[again, which & (SLOTS - 1)]
    return out


class Descent:
    """AdaGrad from shared weights, with the tokens that met each row."""

    def __init__(self, weights: np.ndarray, rate: float) -> None:
        self.start, self.weights, self.rate = weights, weights.copy(), rate
        self.squares = np.ones(len(weights), np.float32)
        self.met = np.zeros(len(weights), np.float64)

    def _move(self, rows: np.ndarray, wanted: np.ndarray) -> None:
        n = wanted.sum(axis=1, keepdims=True)
        grad = np.exp(log_softmax(self.weights, rows)) * n - wanted
        for k in range(rows.shape[1]):
            by = np.argsort(rows[:, k], kind="stable")
            kinds, first = np.unique(rows[by, k], return_index=True)
            g = np.add.reduceat(grad[by], first, axis=0)
            self.met[kinds] += np.add.reduceat(n[by, 0], first)
            self.squares[kinds] += (g * g).mean(axis=1)
            self.weights[kinds] -= self.rate * g / np.sqrt(self.squares[kinds])[:, None]

    def step(self, contexts: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> None:
        kinds, back = np.unique(contexts, return_inverse=True)
        classes = slots >> 6
        wanted = np.bincount(back * CLASSES + classes, counts, len(kinds) * CLASSES).astype(np.float32)
        self._move(class_rows(kinds), wanted.reshape(-1, CLASSES))
        pairs, again = distinct(back * CLASSES + classes, len(kinds) * CLASSES)
        wanted = np.bincount(again * SLOTS + (slots & (SLOTS - 1)), counts, len(pairs) * SLOTS).astype(np.float32)
        self._move(slot_rows(kinds[pairs // CLASSES], pairs % CLASSES), wanted.reshape(-1, SLOTS))

    def moved(self) -> np.ndarray:
        """(ROWS, 65): each row's move times the tokens that met it, and those tokens."""
        return np.column_stack([(self.weights - self.start) * self.met[:, None], self.met]).astype(np.float32)


class SlotMap(dict):
    """Slots of words; those of others are worked out and not kept."""

    def __init__(self, vocab: "Vocabulary") -> None:
        super().__init__((w, int(vocab.slots[i])) for w, i in vocab.words.items())
        self.own = vocab.own

    def __missing__(self, word: bytes) -> int:
        return shared_slot(word, self.own)


@dataclass
class Vocabulary:
    """The head: frequent words with their counts and slots; and what slots hold."""

    words: dict[bytes, int]
    counts: np.ndarray
    slots: np.ndarray
    total: int
    distinct: int
    slot_counts: np.ndarray
    slot_words: np.ndarray
    own: int

    @property
    def base_log(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))

    @property
    def slot_log(self) -> np.ndarray:
        """log10 of what a word's count plus a half is divided by within its slot; a slot's only word is certain."""
        out = np.log10(self.slot_counts + 0.5 * (self.slot_words + 1))
        out[: self.own] = np.log10(self.slot_counts[: self.own] + 0.5)
        return out

    def read(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Head numbers (-1: not in the head), slots and the words that are not in the head."""
        get = self.words.get
        ids = np.fromiter([get(w, -1) for w in parts], np.int64, len(parts))
        out = self.slots[ids]
        away = np.flatnonzero(ids < 0)
        rest = [parts[i] for i in away.tolist()]
        out[away] = [shared_slot(w, self.own) for w in rest]
        return ids, out, rest


def held_out(doc_id):
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(5)) == 1, F.lit(False))


def count_words(docs: DataFrame, text_col: str = "text", flush: int = 400_000) -> DataFrame:
    """(word binary, c long) over all tokens of ``docs``; partitions count before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for x in utf8(batch.column(0)):
                held.update(tokens(x))
                if len(held) >= flush:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, head: int = HEAD, own: int = OWN) -> Vocabulary:
    """What scoring needs of all counts; bounded by ``head`` and the number of slots."""
    top = counts.orderBy(F.desc("c"), "word").limit(head).toArrow()
    names, c = top.column("word").to_pylist(), top.column("c").to_numpy().astype(np.int64)
    alone = sorted([w for w in names if w != END][: own - 1], key=lambda w: w[::-1])
    place = {END: 0} | {w: 1 + i for i, w in enumerate(alone)}
    slots = np.array([place[w] if w in place else shared_slot(w, own) for w in names] + [0], np.int64)
    n, v = np.zeros(WORDS), np.zeros(WORDS)
    bucket = F.crc32(F.substring("word", -2, 2)) % (WORDS - own)
    for r in counts.groupBy(bucket.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n[own + r["k"]], v[own + r["k"]] = r["n"], r["v"]
    total, distinct = int(n.sum()), int(v.sum())
    for w, k in zip(names, c):
        if w in place:  # a slot of its own takes it out of the shared one
            n[place[w]], v[place[w]] = k, 1
            n[shared_slot(w, own)] -= k
            v[shared_slot(w, own)] -= 1
    return Vocabulary({w: i for i, w in enumerate(names)}, c, slots, total, distinct, n, v, own)


def events(docs: DataFrame, shared, text_col: str = "text", flush: int = TASK_TOKENS) -> DataFrame:
    """(context long, slot long, n long) over every token of ``docs``, in a random order of contexts.

    Tasks count before the shuffle and the engine after it; a context has at most ``WORDS`` rows.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_of, found, size = SlotMap(shared.value), [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(found), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["e", "n"])

        for batch in batches:
            for x in utf8(batch.column(0)):
                parts = tokens(x)
                slots = np.fromiter(map(slot_of.__getitem__, parts), np.int64, len(parts))
                found.append((history(slots) << _BITS) | slots)
                size += len(slots)
                if size >= flush:
                    yield out()
                    found, size = [], 0
        if found:
            yield out()

    summed = docs.select(F.col(text_col).alias("text")).mapInArrow(take, "e long, n long").groupBy("e").agg(F.sum("n").alias("n"))
    split = summed.select(F.shiftright("e", _BITS).alias("context"), F.col("e").bitwiseAND(_MASK).alias("slot"), "n")
    tasks = max(parallelism(docs.sparkSession), shared.value.total // TASK_TOKENS)
    return split.repartition(tasks, "context").sortWithinPartitions(F.xxhash64("context"))


def train(found: DataFrame, vocab: Vocabulary, rounds: int = 2, rate: float = 0.2) -> np.ndarray:
    """Weights (ROWS, 64) from the counted events, all of them in each round."""
    from pyspark import TaskContext

    spark = found.sparkSession
    weights = np.zeros((ROWS, SLOTS), np.float32)
    held = vocab.slot_counts.reshape(CLASSES, SLOTS)
    weights[0] = np.log(held.sum(axis=1) + 0.5)
    # slots that no word can fall into get no mass to speak of
    weights[CLASS_ROWS : CLASS_ROWS + CLASSES] = np.where((vocab.slot_words > 0) | (np.arange(WORDS) >= vocab.own), np.log(vocab.slot_counts + 0.5), -30).reshape(CLASSES, SLOTS)
    cuts = np.linspace(0, ROWS, BLOCKS + 1).astype(int)
    tasks = max(1, found.rdd.getNumPartitions())
    schema = "block int, part long, moved binary"
    for i in range(rounds):
        now = spark.sparkContext.broadcast(weights)

        def step(batches: Iterator[pa.RecordBatch], slower: int = 1 + i, now=now) -> Iterator[pa.RecordBatch]:
            descent = Descent(now.value, rate / slower)
            for batch in batches:
                if batch.num_rows:
                    descent.step(*(batch.column(c).to_numpy() for c in ("context", "slot", "n")))
            if descent.met.any():
                parts = [descent.moved()[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                part = np.full(BLOCKS, TaskContext.get().partitionId())
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(part, pa.int64()), pa.array(parts, pa.binary())], names=["block", "part", "moved"])

        def total(key: tuple, table: pa.Table) -> pa.Table:
            ordered = table.sort_by("part").column("moved").to_pylist()
            moved = sum((np.frombuffer(x, np.float32).astype(np.float64) for x in ordered), 0.0).astype(np.float32)
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "moved": pa.array([moved.tobytes()], pa.binary())})

        moves, left = found.mapInArrow(step, schema), tasks
        while left > 1:  # FAN_IN tables of a block at a time
            moves = moves.withColumn("up", F.floor(F.col("part") / FAN_IN)).groupBy("block", "up").applyInArrow(total, schema)
            left = -(-left // FAN_IN)
        for r in moves.collect():
            got = np.frombuffer(r["moved"], np.float32).reshape(-1, SLOTS + 1)
            weights[cuts[r["block"]] : cuts[r["block"] + 1]] += got[:, :SLOTS] / np.maximum(got[:, SLOTS:], 1e-9)
    return weights


def score_documents(docs: DataFrame, train_docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, own: int = OWN) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10).

    A null text is empty: its one token is the end. Repeated rows and null ids are rows of their own; words of one count
    are ordered by their bytes; other columns are ignored; an empty table gives an empty result. With nothing to learn
    from, every word is unseen.
    """
    spark = docs.sparkSession
    counts = materialise(count_words(train_docs, text_col))
    vocab = vocabulary(counts, head, own)
    shared = spark.sparkContext.broadcast(vocab)
    weights = spark.sparkContext.broadcast(train(materialise(events(train_docs, shared, text_col)), vocab))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = shared.value, weights.value
        head_log, slot_log = np.log10(v.counts + 0.5), v.slot_log
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sizes, known, logs, all_slots, all_contexts, words, times = [], [], [], [], [], [], []
                for x in utf8(part.column(1)):
                    ids, slots, rest = v.read(tokens(x))
                    ids = ids[ids >= 0]
                    tail = Counter(rest)
                    sizes.append(len(slots))
                    known.append(len(ids))
                    logs.append(head_log[ids].sum())
                    all_slots.append(slots)
                    all_contexts.append(history(slots))
                    words.append(list(tail))
                    times.append(list(tail.values()))
                slots = np.concatenate(all_slots)
                each = score_slots(w, np.concatenate(all_contexts), slots) / np.log(10) - slot_log[slots]
                gain = np.add.reduceat(each, np.cumsum([0, *sizes[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(gain), pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                    names=["doc_id", "n_tokens", "head_known", "head_log", "model_part", "words", "times"],
                )

    one_pass = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, f"doc_id {kind}, n_tokens long, head_known long, head_log double, model_part double, words array<binary>, times array<bigint>")
    scored = materialise(one_pass.withColumn("row", F.monotonically_increasing_id()))
    tail = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    # the head takes every frequent word, so the words joined here have few rows each
    met = tail.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("tail_known"))
    log = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0))
    return scored.drop("words", "times").join(met, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (log - F.col("n_tokens") * F.lit(vocab.base_log)).alias("base_score"),
        (log + F.col("model_part")).alias("score"),
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = score_documents(docs, docs.where(~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
