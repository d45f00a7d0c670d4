"""Language ID by prediction by partial matching over bytes.

Each language has a tree of byte contexts of orders 0 to ``ORDER``. A byte that its longest context has seen is coded from
that context's counts; otherwise an escape (method C, with exclusion) is coded and the next shorter context asked, down
to a uniform order -1. The statistics are frozen after training, so a byte's code length depends on it and its context
alone: it is that of the longest known string of context and byte, and the escapes of the known longer contexts. The
strings of all languages' trees are kept in one hash table for each order, with the code lengths in every language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import crc_of_id, give_back, load, utf8

UNKNOWN = "und"
ORDER = 5
#: Code lengths that are in memory at once while texts are scored.
CHUNK_CELLS = 1 << 20
TEXTS_PER_LANGUAGE, BYTES_PER_LANGUAGE = 400, 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Strings:
    """Distinct unsigned longs in a hash table: the place of each key, -1 for others."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        slot = self._slot(keys)
        self.first = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.first[slot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        late = np.flatnonzero(self.first[slot] != np.arange(len(keys)))  # their slot holds another key
        self.full = np.zeros(len(self.first), bool)
        self.full[slot[late]] = True
        order = late[np.argsort(keys[late])]
        self.late_keys, self.late_places = keys[order], order

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slot = self._slot(keys)
        out = self.first[slot].astype(np.int64)
        other = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        out[other] = -1
        other = other[self.full[slot[other]]]
        if len(other):
            at = np.minimum(np.searchsorted(self.late_keys, keys[other]), len(self.late_keys) - 1)
            hit = self.late_keys[at] == keys[other]
            out[other[hit]] = self.late_places[at[hit]]
        return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    order: int
    strings: list[Strings]  # by order: a context of that many bytes and the byte after it
    bits: list[np.ndarray]  # (strings, languages)
    contexts: list[Strings]  # by order
    escapes: list[np.ndarray]  # (contexts, languages): bits, 0 where a language does not know the context


def _low(keys: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes of each key."""
    return keys & np.uint64((1 << (8 * n)) - 1)


def _keys(x: np.ndarray, order: int) -> np.ndarray:
    """For each position from ``order`` on: its byte, below the ``order`` bytes before it."""
    n = len(x) - order
    out = np.zeros(max(0, n), np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | x[k : n + k]
    return out


def _grouped(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, back = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(back, counts, len(kinds))


def _tree(texts: list[bytes], order: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """By order: strings and their probabilities, contexts and their escapes (the bits that all unseen bytes pay)."""
    pad = b"\n" * order
    parts = [np.unique(_keys(np.frombuffer(pad + x, np.uint8), order), return_counts=True) for x in texts if x]
    longest = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
    keys, counts = _grouped(longest, np.concatenate([c for _, c in parts]) if parts else np.zeros(0))
    levels = [(keys, counts)]
    for k in range(order, 0, -1):
        levels.append(_grouped(_low(levels[-1][0], k), levels[-1][1]))
    out: tuple[list, list, list, list] = ([], [], [], [])
    for k, (strings, c) in enumerate(reversed(levels)):
        contexts, back = np.unique(strings >> np.uint64(8), return_inverse=True)
        n, kinds = np.bincount(back, c, len(contexts)), np.bincount(back, minlength=len(contexts))
        escape = np.where(kinds == 256, 0, kinds)
        p = c / (n + escape)[back]
        shorter = out[1][-1][np.searchsorted(out[0][-1], _low(strings, k))] if k else np.full(len(strings), 1 / 256)
        rest = 1 - np.bincount(back, shorter, len(contexts))
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = -np.log2(escape / (n + escape) / np.maximum(rest, 1e-300))
        for held, x in zip(out, (strings, p, contexts, np.where(kinds == 256, 0.0, bits))):
            held.append(x)
    return out


def fit(texts: dict[str, list[bytes]], order: int = ORDER) -> Model:
    """Trees from labelled texts, joined."""
    languages = sorted(texts)
    trees = [_tree(texts[lang], order) for lang in languages]
    model = Model(languages, order, [], [], [], [])
    for k in range(order + 1):
        contexts = np.unique(np.concatenate([t[2][k] for t in trees])) if trees else np.zeros(0, np.uint64)
        escapes = np.zeros((len(contexts), len(languages)))
        for i, t in enumerate(trees):
            escapes[np.searchsorted(contexts, t[2][k]), i] = t[3][k]
        strings = np.unique(np.concatenate([t[0][k] for t in trees])) if trees else np.zeros(0, np.uint64)
        shorter = model.bits[-1][model.strings[-1].find(_low(strings, k))] if k else np.full((len(strings), len(languages)), 8.0)
        bits = shorter + escapes[np.searchsorted(contexts, strings >> np.uint64(8))]
        for i, t in enumerate(trees):
            bits[np.searchsorted(strings, t[0][k]), i] = -np.log2(t[1][k])
        for held, x in zip((model.strings, model.bits, model.contexts, model.escapes), (Strings(strings), bits.astype(np.float32), Strings(contexts), escapes.astype(np.float32))):
            held.append(x)
    return model


def code_lengths(model: Model, keys: np.ndarray) -> np.ndarray:
    """(n, languages) bits of each byte after its context."""
    out = np.zeros((len(keys), len(model.languages)), np.float32)
    left = np.arange(len(keys))
    for k in range(model.order, -1, -1):
        own = _low(keys[left], k + 1)
        at = model.strings[k].find(own)
        hit = at >= 0
        out[left[hit]] += model.bits[k][at[hit]]
        left, own = left[~hit], own[~hit]
        if not len(left):
            return out
        at = model.contexts[k].find(own >> np.uint64(8))
        hit = at >= 0
        out[left[hit]] += model.escapes[k][at[hit]]
    out[left] += 8
    return out


def score(model: Model, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
    """The language whose tree codes each text shortest (ties: the first by name), and its posterior, 0 for ``und``."""
    n = len(texts)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    bits = np.zeros((n, len(model.languages)))
    pad = b"\n" * model.order
    chunk = max(1024, CHUNK_CELLS // len(model.languages))
    group: list[int] = []
    total = 0

    def flush() -> None:
        joined = np.frombuffer(b"".join(pad + texts[i] for i in group), np.uint8)
        sizes = np.array([len(texts[i]) for i in group])
        ends = np.cumsum(sizes + model.order) - model.order  # of each text among the positions after the first pad
        for a in range(0, int(ends[-1]), chunk):
            b = min(a + chunk, int(ends[-1]))
            own = code_lengths(model, _keys(joined[a : b + model.order], model.order))
            for j in range(int(np.searchsorted(ends, a, side="right")), len(group)):
                first = max(a, int(ends[j] - sizes[j]))
                if first >= b:
                    break
                bits[group[j]] += own[first - a : int(ends[j]) - a].sum(axis=0, dtype=np.float64)

    for at, x in enumerate(texts):
        if x:
            group.append(at)
            total += len(x)
        if group and (total >= chunk or at == n - 1):
            flush()
            group, total = [], 0
    names, scores = [], np.zeros(n)
    for i, x in enumerate(texts):
        if not x or not _has_letter(x):
            names.append(UNKNOWN)
            continue
        best = int(bits[i].argmin())
        names.append(model.languages[best])
        scores[i] = 1.0 / np.exp2(np.maximum(bits[i, best] - bits[i], -1000.0)).sum()
    return names, scores


_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def _has_letter(x: bytes) -> bool:
    if len(x.translate(None, _LETTERS)) < len(x):
        return True
    return not x.isascii() and any(c.isalpha() for c in x.decode("utf-8", "ignore"))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", texts_per_language: int = TEXTS_PER_LANGUAGE, bytes_per_language: int = BYTES_PER_LANGUAGE) -> Model:
    """Trees from a bounded sample of whole distinct texts.

    Every language with a labelled text is learned: from ``texts_per_language`` of its distinct texts, those of smallest
    hash, or all if it has fewer. Once those taken hold ``bytes_per_language``, no more are, so that a language is at most
    that and one text. However often a text is repeated, it counts once. Rows with a null text or language don't count.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return fit({})
    # a share of the hashes that holds several times what is taken, of all languages alike; then the smallest hashes exactly
    share = F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, min(1.0, 4 * texts_per_language / n))])
    place = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    some = rows.where(place < share[F.col("lang")]).dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    before = F.coalesce(F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = some.withColumn("rank", F.row_number().over(order)).withColumn("before", before)
    got = chosen.where((F.col("rank") <= texts_per_language) & (F.col("before") < bytes_per_language)).select("lang", F.col("text").cast("binary").alias("b")).toArrow()
    texts: dict[str, list[bytes]] = {}
    for lang, b in sorted(zip(got.column("lang").to_pylist(), got.column("b").to_pylist())):
        texts.setdefault(lang, []).append(b)
    del got
    model = fit(texts)
    del texts
    give_back()  # the driver's, which the trees took
    return model


def predict(model: Model, spark: SparkSession, text: Column) -> Column:
    """struct<lang: string, score: double> for a text column."""
    shared = spark.sparkContext.broadcast(model)
    give_back()

    @F.arrow_udf("struct<lang: string, score: double>")
    def language(texts: pa.Array) -> pa.Array:
        give_back()  # what earlier tasks left, before the model is read
        names, scores = [], []
        for at in range(0, len(texts), 256):
            some = score(shared.value, list(utf8(texts.slice(at, 256))))
            names += some[0]
            scores.append(some[1])
        found = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(found)], names=["lang", "score"])

    return language(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    Null texts, and texts without a letter, are ``und`` with score 0; so is everything where no row has a language to
    learn. Languages that code a text alike tie, and the first by name is taken. A null id counts as not held out.
    Repeated rows are scored each; very long texts whole, in chunks; other columns are ignored.
    """
    model = train(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predict(model, docs.sparkSession, F.col(text_col)).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The documents in a learned language with a score of ``least`` or more; columns as given.

    Null texts and texts without a letter go. So does everything where no row has a language to learn. Repeated rows and
    null ids are judged each by their text.
    """
    model = train(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    p = predict(model, docs.sparkSession, F.col(text_col))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), p.alias("p"))
    return marked.where((F.col("p.lang") != UNKNOWN) & (F.col("p.score") >= least)).select("d.*")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))
