"""Finding held-out test passages in subtitle documents: a prefix-filtered set join over shingles.

Documents and items become sequences of units: words for scripts with blanks, characters for Chinese and
Japanese, characters and signs for Thai. A leak is a window of ``WINDOW`` consecutive units of an item
that the spoken text contains. A window contained in a document contains every shingle of the window, so
the rarest shingle of each window is prefix enough: only documents that hold a prefix shingle of an item
become candidates, at the offset the shingle gives. A candidate is verified exactly: all shingles of a
window must stand in the document one after another at that offset.

Shingles are counted over all documents. Documents emit only shingles that some item has; for sets of
items beyond ``MAX_VOCABULARY`` they emit all, and the same joins run without anything broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import materialize, salted_join
from .subtitles import repair, spoken

# kind of units: (units of a window, units of a shingle)
WINDOW = {"word": (14, 5), "char": (36, 12), "thai": (70, 20)}
MAX_VOCABULARY = 2_000_000

# Letters that recognition errors take for one another, folded to one of them; the last
# rows are single characters of other scripts.
_CONFUSED = {
    "e": "c", "t": "f", "l": "i", "1": "i", "0": "o", "h": "b", "5": "s",
    "а": "a", "е": "c", "о": "o", "с": "c", "р": "p", "х": "x", "у": "y", "п": "n", "и": "n", "н": "n", "з": "з", "3": "з", "щ": "ш", "ё": "c", "ъ": "ь",
    "ى": "ي", "ج": "ح", "خ": "ح", "ت": "ب", "ث": "ب", "ة": "ه", "ऱ": "र", "भ": "म", "व": "ब", "ऩ": "न",
    "右": "石", "本": "木", "去": "云", "介": "个", "材": "林", "州": "川", "夭": "天", "妙": "砂", "未": "木", "末": "木", "士": "土", "干": "千", "太": "大",
}
_FOLD = str.maketrans(_CONFUSED)
_PUNCT = re.compile("[\\s!-/:-@\\[-`{-~\x02\x1e -¿­ -⁯　-〿！-／：-＠［-｀｛-･،؛؟।॥ๆฯ�]+")
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\x02 «»¡¿“”„‘’‚‹›…،؛؟।॥—–"
_NUMBER = re.compile(r"[\d०-९٠-٩๐-๙]+")
_LATIN_MARKED = re.compile(r"[ª-ɏ�]|ss")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_THAI = re.compile(r"[ก-๎]")


def fold_word(w: str) -> str:
    """A word without case, punctuation and numbers, recognition errors folded; letters that a wrong
    encoding loses are ``*``."""
    w = w.strip(_EDGES).strip("�")
    if not w or w[0].isdigit() and _NUMBER.fullmatch(_PUNCT.sub("", w)):
        return ""
    if not w.isascii() or "ss" in w:
        w = _LATIN_MARKED.sub("*", w).strip("*")
    w = _PUNCT.sub("", w.replace("*", "\x00")).replace("\x00", "*") if not w.isalpha() else w
    return w.translate(_FOLD).replace("rn", "m").replace("vv", "w")


_ONLY_CJK, _ONLY_THAI = re.compile("[\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]"), re.compile("[\u0e00-\u0e7f]")


class Units:
    """Cuts spoken text into units; folded words are remembered."""

    def __init__(self, limit: int = 300_000):
        self.seen: dict[str, str] = {}
        self.limit = limit

    def sections(self, text: str) -> list[tuple[str, list[str]]]:
        """Units of every script of a text: those of its main script, and of a text of several scripts also
        what the others leave when they are taken out, so that lines between don't part a passage."""
        main = self(text)
        low = text.lower()
        if low.isascii() or not (_CJK.search(low) or _THAI.search(low)):
            return [main]
        flat, out = list(_NUMBER.sub("", _PUNCT.sub("", low)).translate(_FOLD)), [main]
        for kind, own in (("char", _ONLY_CJK), ("thai", _ONLY_THAI)):
            only = [c for c in flat if own.match(c)]
            if len(only) >= WINDOW[kind][0] and kind != main[0]:
                out += [(kind, flat), (kind, only)] if len(only) < len(flat) else [(kind, only)]
        plain = [t for t in low.split() if not (_CJK.search(t) or _THAI.search(t))]
        if len(plain) >= WINDOW["word"][0]:
            out.append(self(" ".join(plain)))
        return out

    def __call__(self, text: str) -> tuple[str, list[str]]:
        low = text.lower()
        if not low.isascii():
            cjk, thai = len(_CJK.findall(low)), len(_THAI.findall(low))
            if cjk + thai > 20 and 3 * (cjk + thai) > len("".join(low.split())):
                flat = _NUMBER.sub("", _PUNCT.sub("", low)).translate(_FOLD)
                return ("char" if cjk >= thai else "thai"), list(flat)
            low = low.replace("…", " ")
        seen, out = self.seen, []
        for t in low.replace("...", " ").split():
            w = seen.get(t)
            if w is None:
                if len(seen) > self.limit:
                    seen.clear()
                w = seen[t] = fold_word(t)
            if w:
                out.append(w)
        return "word", out


def _ident(kind: str, units: list[str], i: int, k: int) -> int:
    return xxhash.xxh64_intdigest(f"{kind} {' '.join(units[i : i + k])}") - (1 << 63)


def shingle_rows(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict | None = None, clean: bool = True) -> DataFrame:
    """(id, kind, sid, pos) of the shingles of whole texts, all of them or those of the vocabulary
    ({kind: (words, {shingle: sid})}). Null texts and ids give no rows."""
    arrow = pa.schema([("id", pa.int64()), ("kind", pa.string()), ("sid", pa.int64()), ("pos", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Units()
        known = shared.value if shared is not None else None
        for b in batches:
            ids, kinds, sids, poss = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or not text:
                    continue
                base = 0
                for kind, units in cut.sections(spoken(repair(text)[0]) if clean else text):
                    k = WINDOW[kind][1]
                    if len(units) < WINDOW[kind][0]:
                        continue
                    if known is None:
                        found = [(_ident(kind, units, p, k), p) for p in range(len(units) - k + 1)]
                    elif kind == "word":
                        words, table = known[kind]
                        found, run = [], 0
                        for p, w in enumerate(units):
                            run = run + 1 if w in words else 0
                            if run >= k and (s := table.get(" ".join(units[p - k + 1 : p + 1]))) is not None:
                                found.append((s, p - k + 1))
                    else:
                        table, flat = known[kind][1], "".join(units)
                        found = [(s, p) for p in range(len(flat) - k + 1) if (s := table.get(flat[p : p + k])) is not None]
                    if found:
                        ids += [i] * len(found)
                        kinds += [kind] * len(found)
                        sids += [s for s, _ in found]
                        poss += [base + p for _, p in found]
                    base += len(units) + 1  # windows never reach from one section into the next
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((ids, kinds, sids, poss), arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(go, "id long, kind string, sid long, pos int")


def _vocabulary(items: DataFrame, id_col: str, text_col: str) -> dict | None:
    """Shingles of the items, if there are few enough to be broadcast (checked before they are fetched)."""
    size = items.agg(F.sum(F.length(text_col))).first()[0] or 0
    if size > MAX_VOCABULARY:
        return None
    cut, known = Units(), {kind: (set(), {}) for kind in WINDOW}
    for (text,) in items.select(text_col).filter(F.col(text_col).isNotNull()).toLocalIterator():
        for kind, units in cut.sections(text):
            words, table = known[kind]
            k = WINDOW[kind][1]
            words.update(units)
            for p in range(len(units) - k + 1):
                table[("" if kind != "word" else " ").join(units[p : p + k])] = _ident(kind, units, p, k)
    return known


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id) of documents whose spoken text contains a window of the item. Items shorter than
    a window match nothing; empty tables give no rows; a repeated document id is one document."""
    vocabulary = _vocabulary(items, item_id, text)
    hits = materialize(shingle_rows(docs, doc_id, text, vocabulary), "hits")
    small = vocabulary is not None
    # items are plain text: no cues to read
    parts = materialize(shingle_rows(items, item_id, text, None, clean=False).withColumnsRenamed({"id": "item", "pos": "at"}), "item-shingles")
    join = (lambda big, x, keys, salt: big.join(F.broadcast(x), keys)) if small else (lambda big, x, keys, salt: salted_join(big, x, keys, salt))
    counts = hits.groupBy("sid").count()
    span = F.create_map(*[F.lit(x) for kind, (w, k) in WINDOW.items() for x in (kind, w - k + 1)])[F.col("kind")]
    ranked = parts.join(counts, "sid", "left").withColumn("n", F.coalesce("count", F.lit(0))).withColumn("span", span)
    # the rarest shingle of each window of an item
    chosen = None
    for kind, (w, k) in WINDOW.items():
        frame = Window.partitionBy("item").orderBy("at").rowsBetween(0, w - k)
        best = F.min(F.struct("n", "sid", "at")).over(frame)
        one = ranked.filter(F.col("kind") == kind).select("item", "sid", best.alias("b"), F.count("*").over(frame).alias("c")).filter(F.col("c") == w - k + 1)
        one = one.select("item", F.col("b.sid").alias("sid"), F.col("b.at").alias("at")).distinct()
        chosen = one if chosen is None else chosen.unionByName(one)
    prefix = materialize(chosen, "prefix")
    found = join(hits.withColumnRenamed("id", "doc"), prefix, ["sid"], ["doc", "pos"]).select("doc", "item", (F.col("pos") - F.col("at")).alias("offset")).distinct()
    found = materialize(found, "candidates")
    # exact containment: consecutive shingles at the candidate's offset
    held = hits.withColumnRenamed("id", "doc").join(found.select("doc").distinct(), "doc", "left_semi")
    pairs = join(held, parts.select("item", "sid", "at"), ["sid"], ["doc", "pos"]).select("doc", "item", (F.col("pos") - F.col("at")).alias("offset"), "pos", "kind").distinct()
    pairs = pairs.join(found, ["doc", "item", "offset"], "left_semi").withColumn("span", span)
    run = F.col("pos") - F.row_number().over(Window.partitionBy("doc", "item", "offset").orderBy("pos"))
    full = pairs.withColumn("run", run).groupBy("doc", "item", "offset", "run").agg(F.count("*").alias("n"), F.first("span").alias("span")).filter("n >= span")
    return full.select(F.col("doc").alias(doc_id), F.col("item").cast("int").alias(item_id)).distinct()
