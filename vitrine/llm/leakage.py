"""Evaluation items inside training documents: prefix-filtered set join and verification."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.words import folded, sentences, words, written_words
from vitrine.session import materialize

#: Share of an item's words that must stand in a document.
CONTAINED = 1 / 3
#: Successive words that count as a passage without being a whole sentence.
PASSAGE = 20
#: Equal words in a row from which a passage is extended, and words of the shingles that are joined.
SEED = 3
#: Words of the shingles by whose frequency a sentence is found to be in very many documents.
STOCK = 5
#: A sentence found in more than this share of the differing documents, and in more than this many, stands in very many.
COMMON_SHARE, COMMON_DOCUMENTS = 0.01, 10
#: Item words that a passage can hold beyond its outermost shared shingle: an edit, two words and a sentence's last; at an end of the item two edits and four words.
BEYOND, BEYOND_AT_END = 4, 6
#: Most positions between the starts of two neighbouring shared shingles of one passage: a shingle, an edit, two words, an edit.
APART = SEED + 4
#: Characters of item texts searched for at once; more items are searched in several rounds over the documents.
BLOCK_CHARS = 8_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Hashes of runs of words, whatever their case and accents; a word is folded and hashed once."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def words(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        out = []
        for w in tokens:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(folded(w))
            out.append(h)
        return np.array(out, dtype=np.uint64)

    @staticmethod
    def runs(hashed: np.ndarray, n: int) -> np.ndarray:
        """One hash per run of ``n`` words."""
        if len(hashed) < n:
            return np.zeros(0, dtype=np.uint64)
        out = np.full(len(hashed) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            out = (out ^ hashed[i : i + len(out)]) * _MULTIPLIER
            out ^= out >> np.uint64(29)
        return out


@dataclass
class Item:
    """An item's sentences, and the shingles of its running words by number."""

    id: int
    sentences: list[list[str]]
    flat: list[str] = field(default_factory=list)
    bounds: list[tuple[int, int]] = field(default_factory=list)
    shingles: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    common: set[int] = field(default_factory=set)
    # Per position, whether its shingle touches a sentence that counts.
    open: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))

    #: Words that must be counted.
    least: int = 0

    def __post_init__(self) -> None:
        for s in self.sentences:
            self.bounds.append((len(self.flat), len(self.flat) + len(s)))
            self.flat += s
        self.least = int(np.ceil(len(self.flat) * CONTAINED - 1e-9))

    @property
    def least_words(self) -> int:
        """Words of a document that can make ``least`` count: three equal ones for five, each as often as the item repeats itself."""
        most = int(np.unique(self.shingles, return_counts=True)[1].max()) if len(self.shingles) else 1
        return -(-3 * self.least // (5 * most))

    def most(self, positions: list[int]) -> int:
        """The most words that can count if only the shingles at ``positions`` (rising) are shared.

        Shared shingles lie in one passage only if they are at most ``APART``
        apart; a passage reaches ``BEYOND`` words further. Words count as whole
        sentences inside one such reach, or if it holds ``PASSAGE`` of them.
        """
        n = len(self.flat)
        counted = bytearray(n)
        for first, last in _chains(positions):
            a = 0 if first <= BEYOND_AT_END else first - BEYOND
            b = n if n - last <= BEYOND_AT_END else last + BEYOND
            inside = [(max(a, s), min(b, e), s >= a and e <= b) for k, (s, e) in enumerate(self.bounds) if s < b and e > a and k not in self.common]
            passage = sum(e - s for s, e, _ in inside) >= PASSAGE
            for s, e, whole in inside:
                if whole or passage:
                    counted[s:e] = b"\1" * (e - s)
        return counted.count(1)

    def prefix(self, frequency: np.ndarray) -> np.ndarray:
        """The shingles of which a containing document must hold one: the rarest, as few as the bound of :meth:`most` allows."""
        at = np.flatnonzero(self.open)
        own = self.shingles[at]
        # Most frequent first; equal shingles stand together.
        order = np.lexsort((own, -frequency[own]))
        own, at = own[order], at[order]
        ends = np.flatnonzero(np.r_[own[1:] != own[:-1], True]) + 1 if len(own) else np.zeros(0, dtype=np.int64)
        if not len(ends) or self.most(sorted(at.tolist())) < self.least:
            return own[:0]
        low, high = 0, len(ends)  # The first `low` shingles can be left out, the first `high` can't.
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.most(sorted(at[: ends[mid - 1]].tolist())) < self.least else (low, mid)
        return np.unique(own[ends[low - 1] if low else 0 :])


def _chains(positions: list[int]) -> list[tuple[int, int]]:
    """Words ``[a, b)`` from the first to the last shingle of positions at most ``APART`` apart."""
    out, first, last = [], None, 0
    for p in positions:
        if first is not None and p - last > APART:
            out.append((first, last + SEED))
            first = None
        first = p if first is None else first
        last = p
    return out if first is None else [*out, (first, last + SEED)]


def indexed(rows: list[tuple[int, str]]) -> tuple[list[Item], np.ndarray]:
    """The items with words, and the sorted hashes of all their shingles; an item's ``shingles`` are positions among these."""
    hasher = Hasher()
    items = [Item(i, s) for i, text in rows if (s := sentences(text))]
    runs = [hasher.runs(hasher.words(x.flat), SEED) for x in items]
    stock = [h for x in items for s in x.sentences for h in hasher.runs(hasher.words(s), STOCK)]
    keys = np.unique(np.concatenate([*runs, np.array(stock, dtype=np.uint64)])) if runs else np.zeros(0, dtype=np.uint64)
    for x, h in zip(items, runs, strict=True):
        x.shingles = np.searchsorted(keys, h)
    return items, keys


def rate(items: list[Item], keys: np.ndarray, frequency: np.ndarray, limit: int) -> None:
    """Finds the sentences that stand in very many documents: more than ``limit`` hold the middle one of its runs of ``STOCK`` words.

    A sentence shorter than that is in as many as its rarest run of ``SEED``
    words; one of fewer words than that counts, as part of a passage.
    """
    hasher = Hasher()
    for x in items:
        for n, (s, e) in enumerate(x.bounds):
            if e - s >= STOCK:
                own = np.unique(np.searchsorted(keys, hasher.runs(hasher.words(x.flat[s:e]), STOCK)))
                df = float(np.median(frequency[own]))
            else:
                own = x.shingles[s : max(s, e - SEED + 1)]
                df = float(frequency[own].min()) if len(own) else 0.0
            if df > limit:
                x.common.add(n)
        counts = np.ones(len(x.flat), dtype=bool)
        for n in x.common:
            counts[slice(*x.bounds[n])] = False
        x.open = np.array([counts[p : p + SEED].any() for p in range(len(x.shingles))], dtype=bool)


class Join:
    """Which items a document may hold, by the shingles both share."""

    def __init__(self, items: list[Item], frequency: np.ndarray):
        self.items = items
        self.least = np.array([x.least for x in items])
        self.least_words = np.array([x.least_words for x in items])
        prefix = [x.prefix(frequency) for x in items]
        self.by_prefix = _lists([(s, n) for n, own in enumerate(prefix) for s in own.tolist()], len(frequency))
        # Positions of all items in one row of numbers.
        self.starts = np.cumsum([0, *[len(x.shingles) for x in items]])
        self.by_shingle = _lists([(int(s), int(self.starts[n]) + p) for n, x in enumerate(items) for p, s in enumerate(x.shingles) if x.open[p]], len(frequency))

    def candidates(self, lists: list[np.ndarray], sizes: list[int]) -> Iterator[tuple[int, int]]:
        """``(row, item)`` of the pairs within the bounds; per row the shared shingles and the number of words."""
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        shingle = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
        r, item = _expand(self.by_prefix, row, shingle)
        met = np.unique(r * len(self.items) + item)
        # Length bound.
        met = met[np.array(sizes)[met // len(self.items)] >= self.least_words[met % len(self.items)]] if len(met) else met
        # Positional bound, over the items' positions that a document shares.
        some = np.isin(row, met // len(self.items))
        r, at = _expand(self.by_shingle, row[some], shingle[some])
        of = r * len(self.items) + np.searchsorted(self.starts, at, "right") - 1
        keep = np.isin(of, met)
        order = np.lexsort((at[keep], of[keep]))
        of, at = of[keep][order], at[keep][order]
        at -= self.starts[of % len(self.items)]
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
        ends = np.r_[begin[1:], len(of)] if len(of) else of
        # A shared shingle can't account for more words than it and its surroundings have.
        able = (ends - begin) * (SEED + 2 * BEYOND) + 2 * BEYOND_AT_END >= self.least[of[begin] % len(self.items)]
        for a, b in zip(begin[able].tolist(), ends[able].tolist(), strict=True):
            r, n = divmod(int(of[a]), len(self.items))
            if self.items[n].most(at[a:b].tolist()) >= self.items[n].least:
                yield r, n


def _lists(pairs: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values by key in one array, and where each key's begin."""
    pairs = sorted(set(pairs))
    keys = np.array([k for k, _ in pairs], dtype=np.int64)
    return np.array([v for _, v in pairs], dtype=np.int64), np.searchsorted(keys, np.arange(n + 1))


def _expand(lists: tuple[np.ndarray, np.ndarray], row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row repeated for every value of its key."""
    values, begin = lists
    n = begin[key + 1] - begin[key]
    total = int(n.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(row, n), values[np.repeat(begin[key], n) + inner] if total else values[:0]


Places = dict[tuple[str, ...], list[int]]


def seeds(tokens: list[str]) -> Places:
    """Where each run of ``SEED`` words stands."""
    places: Places = defaultdict(list)
    for i, run in enumerate(zip(*[tokens[k:] for k in range(SEED)], strict=False)):
        places[run].append(i)
    return places


def passages(item: list[str], document: list[str], places: Places | None = None) -> list[tuple[int, int]]:
    """Runs ``[a, b)`` of item words that stand in the document, single words changed, dropped or added apart.

    Every run of ``SEED`` equal words is extended to both sides, see
    :func:`_extend`. ``places``: the document's :func:`seeds`, if they are
    known; then an item costs its own length and what it shares.
    """
    places = seeds(document) if places is None else places
    shared = sorted((j, i) for i, run in enumerate(zip(*[item[k:] for k in range(SEED)], strict=False)) if run in places for j in places[run])
    found: list[tuple[int, int]] = []
    # Per diagonal the document position up to which a run has gone.
    done: dict[int, int] = {}
    for j, i in shared:
        # Already inside a run on this diagonal or one beside it.
        if any(done.get(j - i + d, -1) > j for d in (-2, -1, 0, 1, 2)):
            continue
        x, y = i + SEED, j + SEED
        before, _ = _extend(item[:i][::-1], document[max(0, j - 2 * i - 8) : j][::-1])
        after, ends = _extend(item[x:], document[y : y + 2 * (len(item) - x) + 8])
        found.append((i - before, x + after))
        for shift, reached in ends:
            done[j - i + shift] = max(done.get(j - i + shift, -1), y + reached)
    return found


def _extend(item: list[str], document: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """How many item words agree from the start on, and the document position reached on each diagonal passed.

    A mismatch is passed over if at most one word on either side is skipped
    and the next two words agree again, or ``SEED`` words if only two stood
    between it and the mismatch before; at the end of the item what is left.
    """
    i = j = 0
    run = SEED
    ends: list[tuple[int, int]] = []
    while i < len(item) and j < len(document):
        if item[i] == document[j]:
            i += 1
            j += 1
            run += 1
            continue
        for di, dj in ((1, 1), (0, 1), (1, 0)):
            left = len(item) - i - di
            need = min(2 if run >= SEED else SEED, left)
            if need and item[i + di : i + di + need] == document[j + dj : j + dj + need]:
                ends.append((j - i, j))
                i, j, run = i + di, j + dj, 0
                break
        else:
            break
    ends.append((j - i, j))
    return i, ends


def contained(item: list[list[str]], common: set[int], document: list[str], places: Places | None = None) -> float:
    """The share of the item's words that stand in the document as whole sentences or long passages.

    ``common``: numbers of the sentences that don't count.
    """
    flat = [w for s in item for w in s]
    if not flat:
        return 0.0
    bounds, at = [], 0
    for s in item:
        bounds.append((at, at + len(s)))
        at += len(s)
    counted = [False] * len(flat)
    for a, b in passages(flat, document, places):
        own = sum(min(b, e) - max(a, s) for n, (s, e) in enumerate(bounds) if n not in common and min(b, e) > max(a, s))
        for n, (s, e) in enumerate(bounds):
            if n in common or min(b, e) <= max(a, s):
                continue
            if a <= s + 1 and b >= e - 1 and min(b, e) - max(a, s) >= min(3, e - s):
                counted[s:e] = [True] * (e - s)
            elif own >= PASSAGE:
                counted[max(a, s) : min(b, e)] = [True] * (min(b, e) - max(a, s))
    return sum(counted) / len(flat)


def leaked(documents: DataFrame, items: DataFrame, *, doc: Column, text: Column, item: Column, item_text: Column) -> DataFrame:
    """``(doc, item, share)``: the documents that hold at least ``CONTAINED`` of an item's words.

    Document and item ids are bigints; null ids, null, empty and wordless texts
    are in no result, nor are items of fewer than ``SEED`` words, which no
    passage can show. Of repeated ids each text counts, the pair has the
    greatest share. Whole texts are read.

    The items are the query set, searched for in blocks of ``BLOCK_CHARS``
    characters, each block in all documents. A first pass over the texts keeps
    of every document the numbers of the item shingles in it; documents with
    the same words are one from there on. Their frequencies, over all differing
    documents, mark the sentences that stand in very many and order an item's
    shingles by rarity. Documents meet an item by a shingle of its prefix (the
    rarest, of which every containing document has one), must be long enough,
    and what they share must be able to cover enough of its sentences by
    position; only the pairs left are read again and compared word by word over
    item-sized windows around shared shingles. None of the bounds loses a pair
    that the comparison accepts.
    """
    spark = documents.sparkSession
    wanted = items.where(item.isNotNull() & item_text.isNotNull()).select(item.cast("bigint").alias("item"), item_text.alias("item_text")).distinct()
    texts = documents.where(doc.isNotNull() & text.isNotNull()).select(doc.cast("bigint").alias("doc"), text.alias("text"))
    blocks = max(1, -(-int(wanted.agg(F.sum(F.length("item_text"))).first()[0] or 0) // BLOCK_CHARS))
    parts = [_search(texts, [tuple(r) for r in wanted.where(F.pmod(F.xxhash64("item_text"), F.lit(blocks)) == n).collect()]) for n in range(blocks)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], "doc bigint, item bigint, share double")
    return reduce(DataFrame.unionByName, parts).groupBy("doc", "item").agg(F.max("share").alias("share"))


def _copy(hashed: np.ndarray) -> int:
    """One number for all texts with the same words."""
    return xxhash.xxh64_intdigest(hashed.tobytes()) - (1 << 63)


def _search(texts: DataFrame, rows: list[tuple[int, str]]) -> DataFrame | None:
    items, keys = indexed(rows)
    if not len(keys):
        return None
    context = texts.sparkSession.sparkContext
    held_keys = context.broadcast(keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hasher = held_keys.value, Hasher()
        for b in batches:
            copies, sizes, found = [], [], []
            for t in b.column(1).to_pylist():
                w = written_words(t)
                hashed = hasher.words(w)
                runs = np.concatenate([hasher.runs(hashed, SEED), hasher.runs(hashed, STOCK)])
                at = np.searchsorted(keys, runs)
                at[at == len(keys)] = 0
                found.append(np.unique(at[keys[at] == runs]).astype(np.int32))
                copies.append(_copy(hashed))
                sizes.append(len(w))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(copies, pa.int64()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["doc", "copy", "n", "shared"])

    shared = materialize(texts.mapInArrow(read, "doc bigint, copy bigint, n int, shared array<int>"), "shared-shingles")
    copies = shared.groupBy("copy", "n").agg(F.min("doc").alias("doc"), F.first("shared").alias("shared"))
    copies = materialize(copies, "differing")
    frequency = np.zeros(len(keys), dtype=np.int64)
    # One number per item shingle, whatever the corpus.
    counted = copies.select(F.explode("shared").alias("s")).groupBy("s").count().toPandas()
    frequency[counted["s"].to_numpy(dtype=np.int64)] = counted["count"].to_numpy(dtype=np.int64)
    rate(items, keys, frequency, max(COMMON_DOCUMENTS, int(COMMON_SHARE * copies.count())))
    held_join = context.broadcast(Join(items, frequency))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = held_join.value
        for b in batches:
            lists = np.split(b.column(3).flatten().to_numpy().astype(np.int64), b.column(3).value_lengths().to_numpy().cumsum()[:-1]) if b.num_rows else []
            pairs = list(join.candidates(lists, b.column(2).to_pylist()))
            at = pa.array([r for r, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([n for _, n in pairs], pa.int32())], names=["doc", "copy", "number"])

    met = materialize(copies.where(F.size("shared") > 0).select("doc", "copy", "n", "shared").mapInArrow(meet, "doc bigint, copy bigint, number int"), "candidates")
    # A document's candidates by number only: the items are at the workers.
    asked = met.groupBy("doc", "copy").agg(F.collect_list("number").alias("numbers"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held_join.value.items
        hasher = Hasher()
        for b in batches:
            copies, numbers, shares = [], [], []
            for t, copy, asked in zip(*[c.to_pylist() for c in b.columns], strict=True):
                w = words(t)
                # Of a repeated id only the text that was met.
                if _copy(hasher.words(w)) != copy:
                    continue
                places = seeds(w)
                for n in asked:
                    copies.append(copy)
                    numbers.append(items[n].id)
                    shares.append(contained(items[n].sentences, items[n].common, w, places))
            yield pa.RecordBatch.from_arrays([pa.array(copies, pa.int64()), pa.array(numbers, pa.int64()), pa.array(shares, pa.float64())], names=["copy", "item", "share"])

    checked = texts.join(asked, "doc").select("text", "copy", "numbers").mapInArrow(verify, "copy bigint, item bigint, share double")
    found = materialize(checked.where(F.col("share") >= CONTAINED), "leaked")
    return shared.select("doc", "copy").join(found, "copy").select("doc", "item", "share")
