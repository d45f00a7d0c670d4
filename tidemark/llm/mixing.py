"""Mixing sources to target weights, in DataFrame functions alone.

A document's block is a prefix of the md5 of its id within its source, so blocks are disjoint and their order is a
permutation; a source has 4096, or 65,536 where there are more than 4096 output shards. A source's target in words becomes an exact quota of block draws: whole passes
over its permuted blocks, then the blocks of one more pass until the words are met, the last of them cut to the word.

Output shards get the draws by a multivariate-hypergeometric splitting tree: a node halves its shards and draws how many
of each source's draws go left, source after source, by inversion of the exact distribution. Each shard then takes that
many of the source's permuted blocks, disjoint from other shards', and orders its documents by a hash. What the mix
takes of a document is the sum of the draws of its block over all shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, load, materialise

WEIGHTS = (1, 2, 3)
CAP = 3
SHARD_WORDS = 1_000_000
#: Draws up to this many rows, some 40 MB, are broadcast to the documents; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(doc_id: Column) -> Column:
    """The place in the permutation; its first four digits are the block."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size in words, h (the place in the permutation), block."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _words(F.col(text_col)).alias("size"), _place(F.col(id_col)).alias("h"))
    return found.withColumn("block", F.substring("h", 1, 4))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) with target, passes and rest (words).

    Shares of the whole by weight, where no source gets more than ``cap`` times its size: with sources in the order
    of size over weight, the level of the rest is the largest of (all - capped before) / (weights from here on).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = by_source.withColumn("w", weight.cast("double"))
    before = Window.orderBy(cap * F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    capped = cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    used = F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - capped) / (F.sum("w").over(everything) - used)
    out = w.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    out = out.withColumn("target", F.least(cap * F.col("source_size").cast("double"), F.col("level") * F.col("w")))
    words = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long"))
    return out.withColumn("passes", passes).withColumn("rest", words - F.col("passes") * F.col("source_size")).drop("w", "level")


def _match(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join where nulls are equal; the keys stay once."""
    other = right.select(*[F.col(c).alias(f"_right_{c}" if c in keys else c) for c in right.columns])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(other, on).drop(*[f"_right_{c}" for c in keys])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(u: Column, population: Column, marked: Column, draws: Column) -> Column:
    """How many of ``draws`` from ``population`` are marked, by inversion at ``u`` in [0, 1) of the exact distribution.

    Weights run from the mode by the ratio of neighbours, within 12 deviations of it, where all else is below double
    precision.
    """
    given = F.struct(u.alias("u"), population.cast("double").alias("n"), marked.cast("double").alias("k"), draws.cast("double").alias("m"))

    def bounds(g: Column) -> Column:
        n, k, m = g["n"], g["k"], g["m"]
        low, high = F.greatest(F.lit(0.0), m + k - n), F.least(k, m)
        mode = F.least(F.greatest(F.floor((m + 1) * (k + 1) / (n + 2)).cast("double"), low), high)
        spread = F.ceil(12 * F.sqrt(F.greatest(F.lit(0.0), m * k * (n - k) * (n - m) / F.greatest(F.lit(1.0), n * n * (n - 1)))) + 12)
        return F.struct(g.alias("g"), low.alias("low"), high.alias("high"), mode.alias("mode"), spread.alias("spread"))

    def weights(b: Column) -> Column:
        g = b["g"]
        n, k, m = g["n"], g["k"], g["m"]
        first, last, at = F.greatest(b["low"], b["mode"] - b["spread"]).cast("long"), F.least(b["high"], b["mode"] + b["spread"]).cast("long"), b["mode"].cast("long")
        up = lambda acc, x: _next(acc, (k - x + 1) * (m - x + 1) / (x * (n - k - m + x)))
        down = lambda acc, x: _next(acc, ((x + 1) * (n - k - m + x + 1)) / ((k - x) * (m - x)))
        none = F.array().cast("array<double>")
        start = F.struct(F.lit(1.0).alias("w"), none.alias("all"))
        above = F.when(last > at, F.aggregate(F.sequence(at + 1, last), start, up)["all"]).otherwise(none)
        below = F.when(first < at, F.reverse(F.aggregate(F.sequence(at - 1, first, F.lit(-1).cast("long")), start, down)["all"])).otherwise(none)
        return F.struct(g["u"].alias("u"), first.alias("first"), last.alias("last"), F.concat(below, F.array(F.lit(1.0)), above).alias("all"))

    def invert(w: Column) -> Column:
        total = F.aggregate(w["all"], F.lit(0.0), lambda a, x: a + x)
        start = F.struct((w["u"] * total).alias("left"), F.lit(0).cast("long").alias("i"))
        step = lambda a, x: F.struct((a["left"] - x).alias("left"), (a["i"] + F.when(a["left"] >= x, 1).otherwise(0)).cast("long").alias("i"))
        return F.least(w["first"] + F.aggregate(w["all"], start, step)["i"], w["last"])

    return _let(_let(_let(given, bounds), weights), invert)


def _next(acc: Column, ratio: Column) -> Column:
    """A running product and the list of its values."""
    return _let(acc["w"] * ratio, lambda w: F.struct(w.alias("w"), F.concat(acc["all"], F.array(w)).alias("all")))


def shard_quotas(quotas: DataFrame, levels: int, seed: int = 11) -> DataFrame:
    """(source, n draws) to (source, shard, n): an exact split among 2 ** levels shards, half after half.

    Each node sends half of its draws (rounded down) left; the left counts of all sources are one draw from the
    multivariate hypergeometric distribution, made source after source from what is left of both. A node is a row with
    a count for each source, so the tree grows without a shuffle.
    """
    kinds = F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "n")))
    nodes = quotas.agg(kinds.alias("kinds")).select(F.lit(0).cast("long").alias("shard"), F.col("kinds.source").alias("sources"), F.col("kinds.n").alias("counts"))
    for level in range(levels):
        u = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "shard", i), F.lit(1 << 52)) / float(1 << 52)  # noqa: B023, E731

        def draw(acc: Column, n: Column) -> Column:
            got = hypergeometric(u(F.size(acc["got"])), acc["population"], n, acc["draws"]).cast("long")  # noqa: B023
            return F.struct((acc["population"] - n).alias("population"), (acc["draws"] - got).alias("draws"), F.concat(acc["got"], F.array(got)).alias("got"))

        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
        start = F.struct(total.alias("population"), F.floor(total / 2).cast("long").alias("draws"), F.array().cast("array<bigint>").alias("got"))
        halves = nodes.withColumn("left", F.aggregate("counts", start, draw)["got"])
        right = F.zip_with("counts", "left", lambda n, x: n - x)
        both = F.array(F.struct((2 * F.col("shard")).alias("shard"), F.col("left").alias("counts")), F.struct((2 * F.col("shard") + 1).alias("shard"), right.alias("counts")))
        nodes = halves.select("sources", F.explode(both).alias("x")).select("x.shard", "sources", "x.counts")
    return nodes.select("shard", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select(F.col("x.sources").alias("source"), "shard", F.col("x.counts").alias("n"))


def draws(leaves: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(source, block, block_size) to (source, block, source_size, target, shard, part, cut): a row for each draw of a block.

    ``part`` counts a block's draws from 0. ``cut`` is the words that the draw takes if it does not take the whole block,
    else null. A block that is not drawn has one row with a null shard. Windows run over one source's blocks or shards,
    65,536 at most, and over the sources. Blocks are given by four digits of their place and come back by three if these
    make blocks enough.
    """
    total = leaves.agg(F.sum("block_size")).first()[0] or 0
    levels = min(16, max(3, (-(-total // shard_words) - 1).bit_length()))
    if levels <= 12:
        leaves = materialise(leaves.groupBy("source", F.substring("block", 1, 3).alias("block")).agg(F.sum("block_size").alias("block_size")))
    ranked = Window.partitionBy("source").orderBy("block")
    roots = targets(leaves.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, cap)
    filled = leaves.where("block_size > 0")
    elder = F.coalesce(F.sum("block_size").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = filled.withColumn("elder", elder).withColumn("rank", (F.row_number().over(ranked) - 1).cast("long"))
    known = _match(placed.withColumn("blocks", F.count("*").over(Window.partitionBy("source"))), roots, "source")
    last = F.greatest(F.lit(0).cast("long"), F.least("block_size", F.col("rest") - F.col("elder")))
    known = materialise(known.withColumn("last", last).withColumn("times", F.col("passes") + (F.col("last") > 0).cast("long")))
    quotas = materialise(known.groupBy("source").agg(F.sum("times").alias("n")))
    # a shard's draws of a source are a run of the source's sequence of draws
    end = F.sum("n").over(Window.partitionBy("source").orderBy("shard"))
    runs = shard_quotas(quotas, levels).withColumn("end", end).where("n > 0")
    dealt = runs.select("source", "shard", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("draw"))
    each = known.where("times > 0").select("source", "block", "source_size", "target", "block_size", "last", "passes", "rank", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("part"))
    each = each.withColumn("draw", F.col("part") * F.col("blocks") + F.col("rank"))
    cut = F.when((F.col("part") == F.col("passes")) & (F.col("last") < F.col("block_size")), F.col("last"))
    met = _match(each, dealt, "source", "draw").select("source", "block", "source_size", "target", "shard", F.col("part").cast("int").alias("part"), cut.alias("cut"))
    drawn = met.select("source", "block").distinct()
    idle = _match(leaves, roots, "source").join(drawn.select(F.col("source").alias("s"), F.col("block").alias("b")), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left_anti")
    none = idle.select("source", "block", "source_size", "target", F.lit(None).cast("long").alias("shard"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("cut"))
    return met.unionByName(none)


def _cut_to(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """``docs`` with blocks of as many digits as those of ``dealt``."""
    digits = dealt.agg(F.max(F.length("block"))).first()[0] or 4
    return docs.withColumn("block", F.substring("h", 1, digits))


def _left(size: Column) -> Column:
    """What a document takes of the words that cut its block, after its elders in the block."""
    elder = F.coalesce(F.sum(size).over(Window.partitionBy("source", "block").orderBy("h", size).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return F.greatest(F.lit(0).cast("long"), F.least(size, F.col("cut") - elder))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words, repeats counted), block, shards.

    ``shards`` lists the output shard of each draw of the document's block, in the order of draws. A null source is a
    source, the last in order. Null and blank texts have size 0 and are never taken. Rows with one id are documents of
    their own; null ids are dealt like the empty id. An empty table gives an empty result; other columns are ignored. Very
    long texts count whole, and a document may be cut. Sources are taken to be few: their targets are found in one task.
    """
    sized = materialise(sizes(docs, id_col, text_col, source_col))
    dealt = materialise(draws(sized.groupBy("source", "block").agg(F.sum("size").alias("block_size")), weights, cap, shard_words))
    whole = F.count_if(F.col("shard").isNotNull() & F.col("cut").isNull())
    shards = F.transform(F.sort_array(F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("part", "shard")))), lambda x: x["shard"])
    by_block = dealt.groupBy("source", "block").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), whole.alias("whole"), F.max("cut").alias("cut"), shards.alias("shards"))
    known = _match(_cut_to(sized, dealt), by_block, "source", "block")
    # only the one block of each source that is cut needs an order of its documents
    taken = F.col("whole") * F.col("size")
    sure = known.where("cut IS NULL").withColumn("taken", taken)
    shared = known.where("cut IS NOT NULL").withColumn("taken", taken + _left(F.col("size")))
    return sure.unionByName(shared).select("doc_id", "source", "size", "source_size", "target", "taken", "block", "shards")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix as documents: a row per copy taken, dealt to shards and shuffled within each; columns as given.

    Each draw of a block yields a copy of each of its documents with a word. Copies are whole: in a block that is cut, a
    document is in that draw if half of it or more is wanted. Null and blank texts go. Rows with one id are documents of
    their own, equal rows too; null ids are dealt like the empty id; a null source is a source. An empty table gives an
    empty result. Shards are a power of two of eight at least, with about ``shard_words`` words or fewer each, up to 65,536.
    """
    sized = sizes(docs, id_col, text_col, source_col)
    dealt = materialise(draws(materialise(sized.groupBy("source", "block").agg(F.sum("size").alias("block_size"))), weights, cap, shard_words).where("shard IS NOT NULL"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(source_col).alias("source"), _place(F.col(id_col)).alias("h"))
    # texts are not shuffled for this join: the draws are few, and their number is checked
    right = F.broadcast(dealt) if dealt.count() <= BROADCAST_ROWS else dealt
    met = _match(_cut_to(keyed, dealt).where(F.col(f"d.`{text_col}`").rlike(WORD)), right, "source", "block")
    whole = met.where("cut IS NULL")
    size = _words(F.col(f"d.`{text_col}`"))
    some = met.where("cut IS NOT NULL").withColumn("size", size).withColumn("left", _left(F.col("size"))).where("2 * left >= size")
    columns = ["d", "shard", "part"]
    n = (dealt.agg(F.max("shard")).first()[0] or 0) + 1
    found = whole.select(*columns).unionByName(some.select(*columns)).repartitionById(n, F.col("shard").cast("int"))
    return found.sortWithinPartitions("shard", F.xxhash64("part", F.col(f"d.`{id_col}`"))).select("d.*")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::DOUBLE AS w
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM by_source
  WINDOW b AS (ORDER BY 3 * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(3 * source_size::DOUBLE, (SELECT max(level) FROM levels) * w) AS target FROM levels
), quotas AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes FROM targets
), placed AS (
  SELECT s.*, q.source_size, q.target, q.passes, round(q.target)::BIGINT - q.passes * q.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS elder
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, rest - elder)))::BIGINT AS taken FROM placed
"""
