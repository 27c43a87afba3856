"""Mixing sources to target weights, measured in tokens of a public tokenizer.

Budgets go down a tree (by default source, then language): a node's budget is dealt to its children by
weight, none beyond what it can give (its tokens times the permitted repeats). What a child can't take
goes to its siblings by their weights; only what all of them can't take goes back to the parent's
siblings. Each leaf fills its budget with whole epochs over its documents and, of the last epoch, with the
prefix of a seeded order of documents that fits.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the public byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_LEAVES = 100_000


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, name: str = "tokens") -> DataFrame:
    """Add the number of tokens of the whole text; null for null texts. The vocabulary file must lie at
    ``tokenizer`` on every executor."""
    others = [c for c in docs.columns if c != text]
    schema = docs.select(*others).schema.add(name, "long")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoding(tokenizer)
        for b in batches:
            at = b.schema.names.index(text)
            counts = [None if t is None else len(e.encode_ordinary(t)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns) if i != at], pa.array(counts, pa.int64())], names=[*others, name])

    return docs.select(*others, text).mapInArrow(go, schema)


def source_name(c: Column) -> Column:
    """Source without case, padding and spelling of its joint; null stays null."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def language_name(c: Column) -> Column:
    """Two-letter language of a tag, ``und`` if there is none."""
    tag = F.lower(F.trim(F.coalesce(c, F.lit("und"))))
    first = F.regexp_extract(tag, r"^([a-z]+)", 1)
    three = F.create_map(*[F.lit(x) for pair in {"eng": "en", "ger": "de", "deu": "de", "spa": "es", "fra": "fr", "fre": "fr", "rus": "ru", "zho": "zh", "chi": "zh", "jpn": "ja", "tha": "th", "hin": "hi", "ara": "ar"}.items() for x in pair])
    return F.when(first == "", "und").otherwise(F.coalesce(three[first], first))


@dataclass
class Node:
    """A node of the tree: weight among its siblings, and for leaves what they can give at most."""

    weight: float
    capacity: float = 0.0
    children: dict[str, Node] | None = None

    def can_give(self) -> float:
        return self.capacity if self.children is None else sum(c.can_give() for c in self.children.values())


def deal(weights: dict[str, float], capacity: dict[str, float], budget: float) -> dict[str, float]:
    """Deal a budget by weight, none beyond capacity; shortages go to the others by their weights.
    Children without weight get nothing while others have room."""
    given = {k: 0.0 for k in weights}
    open_ = {k for k in weights if capacity[k] > 0 and weights[k] > 0}
    left = min(budget, sum(capacity[k] for k in open_))
    while open_ and left > 1e-9 * max(1.0, budget):
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if given[k] + left * weights[k] / total >= capacity[k]}
        if not full:
            for k in open_:
                given[k] += left * weights[k] / total
            break
        for k in full:
            left -= capacity[k] - given[k]
            given[k] = capacity[k]
        open_ -= full
    return given


def budgets(node: Node, budget: float, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], float]:
    """Budget of every leaf below a node."""
    if node.children is None:
        return {path: min(budget, node.capacity)}
    shares = deal({k: c.weight for k, c in node.children.items()}, {k: c.can_give() for k, c in node.children.items()}, budget)
    out: dict[tuple[str, ...], float] = {}
    for k, c in node.children.items():
        out |= budgets(c, shares[k], (*path, k))
    return out


@dataclass
class Mixture:
    documents: DataFrame  # doc_id, source, language, tokens, uses
    shares: DataFrame  # source, target_weight, max_repeats, available_tokens, mixed_tokens, share


def mix_sources(docs: DataFrame, weights: DataFrame, total: int | None = None, seed: int = 42, tokenizer: str = TOKENIZER, buckets: int = 1024) -> Mixture:
    """A mix of about ``total`` tokens; by default as many as leave every source that has documents its
    share. Beyond that, what a source can't give goes to the others.

    No document is used more often than its source's ``max_repeats``. Documents without text, of no
    source or of a source without weight are not used; repeated rows are documents of their own. Sources
    without documents get nothing and their share goes to the others. Empty tables give an empty mix.
    """
    spark = docs.sparkSession
    named = docs.select("doc_id", source_name(F.col("source")).alias("source"), language_name(F.col("lang")).alias("language"), "text")
    listed = weights.dropna(subset=["source", "target_weight", "max_repeats"]).select(source_name(F.col("source")).alias("source"), "target_weight", "max_repeats").limit(MAX_LEAVES + 1).collect()
    if len(listed) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} sources have a weight")
    wanted = {r["source"]: (float(r["target_weight"]), int(r["max_repeats"])) for r in listed}
    sized = materialize(count_tokens(named.filter(F.col("source").isNotNull() & F.col("text").isNotNull()), tokenizer=tokenizer).filter("tokens > 0"), "tokens")
    key = F.xxhash64(F.col("doc_id"), F.col("tokens"), F.lit(seed))
    leaf = ["source", "language"]
    placed = sized.withColumn("key", key).withColumn("bucket", F.pmod(F.shiftright("key", 40), F.lit(buckets)).cast("int"))
    per_bucket = materialize(placed.groupBy(*leaf, "bucket").agg(F.sum("tokens").alias("tokens")), "buckets")
    leaves = per_bucket.groupBy(*leaf).agg(F.sum("tokens").alias("t")).limit(MAX_LEAVES + 1).collect()
    if len(leaves) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves in the tree of sources and languages")
    root = Node(1.0, children={s: Node(w, children={}) for s, (w, _) in wanted.items()})
    for s, l, t in leaves:
        if s in wanted:
            root.children[s].children[l] = Node(float(t), float(t) * wanted[s][1])
    have = {(s, l): t for s, l, t in leaves if s in wanted}
    if total is None:
        there = {s: (n.weight, n.can_give()) for s, n in root.children.items() if n.weight > 0 and n.can_give() > 0}
        total = int(min((most / w for w, most in there.values()), default=0.0) * sum(w for w, _ in there.values()))
    dealt = budgets(root, float(total))
    rows = [(s, l, int(b // have[s, l]), int(b) - int(b // have[s, l]) * have[s, l]) for (s, l), b in dealt.items()]
    plan = spark.createDataFrame(rows, "source string, language string, epochs int, rest long")
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per_bucket.withColumn("before", before).drop("tokens").join(F.broadcast(plan), leaf)  # at most MAX_LEAVES rows
    within = Window.partitionBy(*leaf, "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.withColumn("upto", F.sum("tokens").over(within)).join(starts, [*leaf, "bucket"])
    uses = F.col("epochs") + (F.col("before") + F.col("upto") <= F.col("rest")).cast("int")
    mixed = filled.withColumn("uses", uses).filter("uses > 0").select("doc_id", *leaf, "tokens", "uses")
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("mixed_tokens"))
    stock = per_bucket.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    target = spark.createDataFrame([(s, w, m) for s, (w, m) in wanted.items()], "source string, target_weight double, max_repeats int")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    shares = target.join(stock, "source", "left").join(used, "source", "left").select("source", "target_weight", "max_repeats", zero("available_tokens"), zero("mixed_tokens"))
    everything = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
    return Mixture(mixed, shares.withColumn("share", F.when(everything > 0, F.col("mixed_tokens") / everything).otherwise(F.lit(0.0))))
