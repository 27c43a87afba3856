"""Deduplicating new batches of names against everything accepted before.

A name is normalised; its vector is the count of each letter of its full name (indifferent to the order of
fields), and its distance to another name is the L1 distance of the vectors. Vectors are filed in an
inverted file of cells: letters fall into ``GROUPS`` groups and a cell holds all vectors with the same
number of letters in each. The distance of the group counts is a lower bound of the distance of the
vectors, so cells are probed ring by ring:

    bound 0   the name's own cell
    bound 1   one letter more or less in one group
    bound 2   one letter of one group for one of another

One slip of the pen (a letter changed, left out, put in, or two neighbours swapped) moves a vector by at
most 2, so no match can lie beyond ring 2 and probing ends there. What a cell holds is compared by its full
vector first and then exactly: at most one slip between the full names, with the fields in any order.

A vector is kept in unary, as the name's letters in order, and is filed once, so two names meet in at most
one cell. Cells lie in shards by name length and first group count; a batch reads only the shards that its
rings touch. Exact copies of one normalised name are one entry (its earliest id), so a name held by a
third of all rows costs one entry.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import materialize, shared_dir
from ..errors import ConcurrentCommitError
from ..sources.files import FileStore

# Look-alikes of Latin letters.
LOOKALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ı": "i", "ŧ": "t", "ɑ": "a", "ɡ": "g",
    "0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "|": "l",
}
# Titles and suffixes that are no names, but for those that are names too (where two names
# remain without them, they are none; suffixes are tried first); single letters are initials.
ADDITIONS = (
    "mr mrs ms miss mx sir dame lord lady dr prof professor doctor rev hon fr sr jr junior senior esq phd md mba dds ii iii iv vi vii viii "
    "herr frau hr fräulein señor señora sra srta don doña mme mlle monsieur madame signor signora sig dott ing mag dipl capt captain col gen lt maj sgt"
).split()
ALSO_NAMES = (("junior", "senior"), ("don", "vi", "il", "gen"))
# Marks that may be left out (of Latin, Greek, Cyrillic; points of Hebrew and Arabic) and
# scripts in which a character is a syllable or a word.
MARKS = r"\u0300-\u036f\u0591-\u05bd\u05bf-\u05c7\u064b-\u0652\u0670\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f"
SYLLABLES = r"[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]"


def _letter_table() -> dict[str, str]:
    """Lower-case letters with marks, full-width and other compatibility forms to their base letter."""
    table = {}
    for start, end in ((0xAA, 0x250), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0x2100, 0x2150), (0xFF01, 0xFF5F)):
        for c in map(chr, range(start, end)):
            base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x)).lower()
            if len(base) == 1 and base.isascii() and base.isalnum() and base != c:
                table[c] = base
    table |= LOOKALIKE
    return {k: LOOKALIKE.get(v, v) for k, v in table.items()}


def _let(value: Column, body) -> Column:
    """body(value), with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(words: Column, some: tuple[str, ...]) -> Column:
    """The words without some, if two remain."""
    return _let(words, lambda ws: _let(F.filter(ws, lambda w: ~w.isin(*some)), lambda rest: F.when(F.size(rest) > 1, rest).otherwise(ws)))


def name_tokens(*fields: Column) -> Column:
    """Words of a full name, of any script, without case, marks, look-alikes, invisible characters,
    punctuation, titles, suffixes and initials. ``i`` and ``l`` are one letter, but not yet where titles and
    suffixes are told from names: ``Li`` is a name, ``lI`` and ``ll`` are the suffix."""
    table = _letter_table()
    text = F.lower(F.regexp_replace(F.concat_ws(" ", *fields), r"(?<!\p{L})lI(?!\p{L})", "II"))
    text = F.regexp_replace(F.translate(text, "".join(table), "".join(table.values())), rf"[{MARKS}\p{{Cf}}'’`´]", "")
    one = lambda w: w.replace("l", "i")
    drop = sorted({one("".join(table.get(c, c) for c in w)) for w in ADDITIONS})
    kept = ["li", *(w for some in ALSO_NAMES for w in some)]
    words = F.split(F.regexp_replace(text, r"[^\p{L}\p{M}]+", " "), " ")
    words = F.filter(words, lambda w: ((F.length(w) > 1) | w.rlike(SYLLABLES)) & (~F.translate(w, "l", "i").isin(*drop) | w.isin(*kept)))
    for some in ALSO_NAMES:
        words = _without(words, some)
    return F.transform(words, lambda w: F.translate(w, "l", "i"))


def rotations(words: Column) -> Column:
    """The full name run together, starting at each of its words."""
    n = F.size(words)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(words, i, n), ""), F.array_join(F.slice(words, 1, i - 1), "")))


def forms(rows: DataFrame, id_col: str, first: str, last: str, others: list[str] | None = None) -> DataFrame:
    """(id, form, others): the normalised full name, words parted by blanks and turned so that it reads lowest.
    Rows without id or with fewer than two names have none."""
    w = rows.select(F.col(id_col).cast("long").alias("id"), name_tokens(F.col(first), F.col(last)).alias("w"), *(others or [])).filter((F.size("w") > 1) & F.col("id").isNotNull())
    turned = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.concat(F.slice("w", i, F.size("w")), F.slice("w", 1, i - 1)), " "))
    return w.select("id", F.array_min(turned).alias("form"), *(others or []))


GROUPS, BASE, SHARDS, RADIUS = 12, 32, 64, 2
MERGE_AFTER = 12  # appends that are kept apart, at most


def _moves() -> list[tuple[int, int, int, int]]:
    """(bound, change of the cell's number, of the length, of the first group) to every cell within reach. A
    slip changes the length by at most 1."""
    out = [(0, 0, 0, 0)]
    one = [(1, d * BASE**g, d, d if g == 0 else 0) for g in range(GROUPS) for d in (1, -1)]
    out += one
    out += [(2, BASE**g - BASE**h, 0, (g == 0) - (h == 0)) for g in range(GROUPS) for h in range(GROUPS) if g != h]
    return out


def _shard(length: Column, first: Column) -> Column:
    return F.pmod(length * 7 + first, F.lit(SHARDS)).cast("int")


def cell_entries(f: DataFrame) -> DataFrame:
    """(shard, cell, length, first_group, form, vector, first_id): every form in its cell. A cell's number is
    linear in the group counts, so a move to another cell is an addition."""
    h = f.withColumn("vector", F.array_join(F.array_sort(F.split(F.replace("form", F.lit(" ")), "")), ""))
    groups = F.transform(F.split("vector", ""), lambda c: F.pmod(F.ascii(c), F.lit(GROUPS)))
    cell = F.aggregate(groups, F.lit(0).cast("long"), lambda a, g: a + F.element_at(F.array(*[F.lit(BASE**i).cast("long") for i in range(GROUPS)]), g + 1))
    sized = h.select("form", "vector", "first_id", F.length("vector").alias("length"), F.size(F.filter(groups, lambda g: g == 0)).alias("first_group"), cell.alias("cell"))
    return sized.select(_shard(F.col("length"), F.col("first_group")).alias("shard"), "cell", "length", "first_group", "form", "vector", "first_id")


def probes(entries: DataFrame) -> DataFrame:
    """(shard, cell, bound, q, q_vector, q_id): the cells within reach of each entry."""
    moves = F.array(*[F.struct(F.lit(b).alias("bound"), F.lit(c).cast("long").alias("c"), F.lit(n).alias("n"), F.lit(g).alias("g")) for b, c, n, g in _moves()])
    e = entries.select("cell", "length", "first_group", F.col("form").alias("q"), F.col("vector").alias("q_vector"), F.col("first_id").alias("q_id"), F.explode(moves).alias("m"))
    return e.select(_shard(F.col("length") + F.col("m.n"), F.col("first_group") + F.col("m.g")).alias("shard"), (F.col("cell") + F.col("m.c")).alias("cell"), F.col("m.bound").alias("bound"), "q", "q_vector", "q_id")


def _one_slip(a: Column, b: Column) -> Column:
    d = F.levenshtein(a, b, 2)
    differ = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    i, j = F.element_at(differ, 1), F.element_at(differ, 2)
    swapped = (F.length(a) == F.length(b)) & (F.size(differ) == 2) & (j == i + 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, j, F.lit(1))) & (F.substr(a, j, F.lit(1)) == F.substr(b, i, F.lit(1)))
    return F.when(d == 2, swapped).otherwise((d >= 0) & (d <= 1))


def same_name(form_a: Column, form_b: Column) -> Column:
    """At most one slip (none in scripts of syllables) between the full names, the words of either taken in any rotation (a blank may
    stand anywhere, so the words of the two need not match one to one)."""
    ends = rotations(F.split(form_b, " "))
    slip = lambda a, b: F.when(a.rlike(SYLLABLES) | b.rlike(SYLLABLES), a == b).otherwise(_one_slip(a, b))
    return F.exists(rotations(F.split(form_a, " ")), lambda a: F.exists(ends, lambda b: slip(a, b)))


_CELLS = "cell long, length int, first_group int, form string, vector string, first_id long, shard int"


class NameIndex:
    """Persisted cells under ``path``. Reopening a path goes on with what is there.

    ``probe`` finds, for each row of a batch, the earliest row (of history or of the batch) that names
    the same person; ``append`` files the batch. An append writes a folder of its own and counts once its
    commit file exists, which is created exclusively: a part of a batch is never seen, a batch whose
    ``token`` was committed is not filed again, and of two writers that race one fails with
    ``ConcurrentCommitError``. Of more than ``MERGE_AFTER`` folders one is made.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), FileStore(spark)

    def _state(self) -> tuple[int, dict]:
        names = [n for n in self.files.names(f"{self.path}/commits") if n.endswith(".json")]
        last = max((int(n[:-5]) for n in names), default=-1)
        return last, json.loads(self.files.read_text(f"{self.path}/commits/{last}.json")) if names else {"folders": [], "tokens": []}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _CELLS)
        return self.spark.read.schema(_CELLS).option("basePath", self.path).parquet(*[f"{self.path}/part={f}" for f in folders]).select(*[c.split()[0] for c in _CELLS.split(", ")])

    def cells(self) -> DataFrame:
        return self._read(self._state()[1]["folders"])

    def prepare(self, batch: DataFrame, id_col: str = "id", first: str = "firstname", last: str = "lastname") -> tuple[DataFrame, DataFrame]:
        """(rows with their form, entries of the distinct forms)."""
        f = materialize(forms(batch, id_col, first, last), "forms")
        return f, self.entries(f)

    def entries(self, rows: DataFrame) -> DataFrame:
        return materialize(cell_entries(rows.groupBy("form").agg(F.min("id").alias("first_id"))), "entries")

    def append(self, entries: DataFrame, token: str | None = None) -> None:
        last, state = self._state()
        if token is not None and token in state["tokens"]:
            return
        name, folders = uuid.uuid4().hex, state["folders"]
        if len(folders) >= MERGE_AFTER:
            one = F.min("first_id").alias("first_id")
            entries = self._read(folders).unionByName(entries).groupBy("shard", "cell", "length", "first_group", "form", "vector").agg(one)
            folders = []
        entries.repartition("shard").write.partitionBy("shard").parquet(f"{self.path}/part={name}")
        try:
            self.files.create(f"{self.path}/commits/{last + 1}.json", json.dumps({"folders": [*folders, name], "tokens": [*state["tokens"], *([token] if token is not None else [])]}))
        except ConcurrentCommitError:
            self.files.delete_folder(f"{self.path}/part={name}")
            raise

    def probe(self, rows: DataFrame, entries: DataFrame) -> DataFrame:
        """(id_a, id_b): for rows with an earlier namesake, the earliest."""
        query = probes(entries)
        touched = [r[0] for r in query.select("shard").distinct().collect()]  # of ``SHARDS`` at most
        there = self.cells().filter(F.col("shard").isin(touched)).unionByName(entries).select("cell", "form", "vector", "first_id")
        met = there.join(query.select("cell", "q", "q_vector", "q_id").hint("shuffle_hash"), "cell").filter(F.col("first_id") < F.col("q_id"))
        # full vectors within the radius (in unary each moved letter is one edit or two), then the exact check
        near = met.filter((F.levenshtein("vector", "q_vector", RADIUS) >= 0) & same_name(F.col("form"), F.col("q"))).groupBy("q").agg(F.min("first_id").alias("near"))
        own = rows.groupBy("form").agg(F.min("id").alias("own"))
        best = own.join(near, own["form"] == near["q"], "left").select("form", F.least("own", F.coalesce("near", "own")).alias("id_a"))
        return rows.join(best, "form").filter(F.col("id_a") < F.col("id")).select("id_a", F.col("id").alias("id_b"))


def dedup_batches(history: DataFrame, batches: DataFrame, path: str | None = None, per_round: int = 5, batch_col: str = "batch_no") -> DataFrame:
    """(id_a, id_b) for all rows of ``batches``, taken in order of ``batch_col``; of batches that wait
    already ``per_round`` are probed together, which changes no result. Rows without a batch number come
    last. Rows without two names, or without id, are no cases. Empty history or batches give no pairs."""
    spark = history.sparkSession
    index = NameIndex(spark, path or shared_dir(spark, "name-index"))
    index.append(index.prepare(history)[1], "history")
    named = materialize(forms(batches, "id", "firstname", "lastname", [batch_col]), "forms")
    numbers = [r[0] for r in named.select(batch_col).distinct().orderBy(F.col(batch_col).asc_nulls_last()).collect()]
    found = [spark.createDataFrame([], "id_a long, id_b long")]
    for k in range(0, len(numbers), per_round):
        some = numbers[k : k + per_round]
        rows = named.filter(F.col(batch_col).isin([x for x in some if x is not None]) | (F.col(batch_col).isNull() if None in some else F.lit(False))).select("id", "form")
        entries = index.entries(rows)
        found.append(materialize(index.probe(rows, entries), "pairs"))
        if k + per_round < len(numbers) or path:
            index.append(entries, f"batches {some}")
    return reduce(DataFrame.unionByName, found)
