"""Languages of documents and of the stretches in them: Bayesian evidence fusion."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.words import folded, has_marks, visible
from vitrine.session import bounded_lookup, materialize

LANGUAGES = ["pt", "es", "en", "fr", "it", "de"]
# Codes and names of the languages, as labels may give them.
LABELS = {
    "pt": ["pt", "por", "portugues", "portuguese", "portugais", "portoghese"],
    "es": ["es", "spa", "esp", "espanol", "spanish", "castellano", "espanhol", "espagnol", "spagnolo"],
    "en": ["en", "eng", "english", "ingles", "anglais", "inglese"],
    "fr": ["fr", "fra", "fre", "francais", "french", "frances", "francese"],
    "it": ["it", "ita", "italiano", "italian", "italien"],
    "de": ["de", "deu", "ger", "deutsch", "german", "alemao", "aleman", "allemand", "tedesco"],
}
#: Size of the hashed feature space; the model is this many rows of one number per language, whatever the corpus.
BUCKETS = 1 << 16
#: Words a stretch needs to count as a sentence.
SENTENCE_WORDS = 5
#: Bracketed or quoted stretches up to this many words are asides, not sentences.
ASIDE_WORDS = 6
#: Weight of a word's likelihood, against features that overlap.
WORD_WEIGHT = 1.0
#: Log-odds by which a stretch must prefer a language to teach it, and to be counted as it beside a document's main language.
TEACH_MARGIN, OTHER_MARGIN = 4.0, 3.0
#: Log-odds by which two languages in a row must explain a stretch better than one.
SPLIT_MARGIN = 8.0
#: Strength of the parent in the smoothed priors, in documents.
SMOOTHING = 20.0
#: Labelled documents that teach the model at most; of more, those with the least hashes of their id.
TRAIN_DOCUMENTS = 20_000
#: Words a scorer remembers.
KNOWN_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ASIDE = re.compile(r"\([^()\n]+\)|\"[^\"\n]+\"|“[^”\n]+”|«[^»\n]+»|…[^…\n]+…")
_ADDRESS = re.compile(r"\b(?:Rua|R\.|Avenida|Av\.|Travessa|Alameda|Praça|Rodovia|Estrada)(?:\s+(?:d[aeo]s?\b|e\b|[A-ZÀ-Ý][\w'’.-]*|\d+))+")
_END = re.compile(
    r"[.!?…]+[\"')\]]*\s+|;\s*|\n\s*\n|(?<=[.!?…:;])\s*\n|\n(?=\s*(?:[-*•]|\d+[.)]|[A-ZÀ-Ý¡¿]))"
    r"|\s[—–/|•·]\s|[☀-➿\U0001F300-\U0001FAFF]"
)


def stretches(text: str | None, fold: bool = True) -> list[list[str]]:
    """The words of each sentence-like stretch; asides, addresses, numbers and markup left out.

    Without ``fold`` the words stay as written, for readers that remember what they folded.

    A full stop ends a stretch even if it is an abbreviation's: what follows is
    a stretch of the same language, or too short to count. A line break does so
    behind punctuation, or before a capital or a list mark; dashes, slashes and
    bars between spaces and pictographs part stretches too.
    """
    if not text:
        return []
    text = visible(text)
    text = _ASIDE.sub(lambda m: " " if len(_WORD.findall(m[0])) <= ASIDE_WORDS else ". " + m[0][1:-1] + ". ", text)
    text = _ADDRESS.sub(" ", text).replace("\0", " ")
    pieces = _END.split(text)
    if fold or has_marks(text):
        pieces = folded("\0".join(pieces)).split("\0")
    return [w for s in pieces if (w := _WORD.findall(s))]


def features(word: str) -> np.ndarray:
    """Buckets of a word in plain form, of its beginning and end, and of its runs of three letters."""
    framed = f"<{folded(word)}>"
    parts = [framed, "^" + framed[:4], "$" + framed[-4:], *[framed[i : i + 3] for i in range(len(framed) - 2)]]
    return np.array([xxhash.xxh32_intdigest(p) % BUCKETS for p in parts], dtype=np.int32)


class Scorer:
    """Log-likelihoods of stretches under a table of log-probabilities (buckets x languages)."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LANGUAGES)))

    def each(self, words: list[str]) -> np.ndarray:
        """One row per word."""
        known, at = self.known, []
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words:
            i = known.get(w)
            if i is None:
                i = known[w] = len(known)
                if i >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[i] = self.table[features(w)].mean(axis=0) * WORD_WEIGHT
            at.append(i)
        return self.rows[at]

    def read(self, stretches: list[list[str]]) -> list[list[tuple[int, np.ndarray]]]:
        """:meth:`parts` of every stretch; those that one language explains well enough are told apart all at once."""
        if not stretches:
            return []
        n = np.array([len(s) for s in stretches])
        starts = np.cumsum(n) - n
        each = self.each([w for s in stretches for w in s])
        totals = np.add.reduceat(each, starts)
        of = np.repeat(np.arange(len(n)), n)
        gain = np.cumsum(each - each[np.arange(len(each)), totals.argmax(axis=1)[of], None], axis=0)
        gain -= np.vstack([np.zeros(gain.shape[1]), gain])[starts][of]
        # The least sum so far within each stretch: every stretch lies below all before it.
        below = of[:, None] * (gain.max() - gain.min() + 1.0)
        least = np.minimum(np.minimum.accumulate(gain - below, axis=0) + below, 0.0)
        rise = np.maximum.reduceat((gain - least).max(axis=1), starts)
        return [self.parts(s) if k >= 2 * SENTENCE_WORDS and r >= SPLIT_MARGIN / 2 - 1e-6 else [(int(k), t)] for s, k, r, t in zip(stretches, n, rise, totals, strict=True)]

    def parts(self, words: list[str]) -> list[tuple[int, np.ndarray]]:
        """(number of words, log-likelihoods) of a stretch, or of its parts if several languages explain it much better than one.

        The best sequence of parts of ``SENTENCE_WORDS`` or more, each change
        of language costing ``SPLIT_MARGIN``, by dynamic programming.
        """
        each = self.each(words)
        total = each.sum(axis=0)
        n, least = len(words), SENTENCE_WORDS
        if n < 2 * least:
            return [(n, total)]
        # No part gains half a margin on the best language: no sequence of parts can pay for its changes, of which there are at least half as many.
        gain = np.vstack([np.zeros(each.shape[1]), np.cumsum(each - each[:, [int(total.argmax())]], axis=0)])
        if (gain - np.minimum.accumulate(gain, axis=0)).max() < SPLIT_MARGIN / 2:
            return [(n, total)]
        sums = np.vstack([np.zeros(each.shape[1]), np.cumsum(each, axis=0)])
        # Of the first j words, by the language of the last part: the best score, where that part starts.
        score = np.full(sums.shape, -np.inf)
        start = np.zeros(sums.shape, dtype=np.int64)
        score[least] = sums[least]
        for j in range(least + 1, n + 1):
            score[j], start[j] = score[j - 1] + each[j - 1], start[j - 1]
            if j >= 2 * least:
                changed = score[j - least].max() - SPLIT_MARGIN + sums[j] - sums[j - least]
                better = changed > score[j]
                score[j][better], start[j][better] = changed[better], j - least
        out, end = [], n
        while end:
            begin = int(start[end][int(score[end].argmax())])
            out.append((end - begin, sums[end] - sums[begin]))
            end = begin
        return out[::-1]


def log_table(counts: np.ndarray) -> np.ndarray:
    """Smoothed log-probabilities of the buckets per language."""
    counts = counts + 0.1
    return np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32)


class Counter:
    """Feature counts per language; words are counted first and turned into features once."""

    def __init__(self) -> None:
        self.words: list[dict[str, int]] = [{} for _ in LANGUAGES]
        self.counts = np.zeros((BUCKETS, len(LANGUAGES)))

    def add(self, words: list[str], language: int) -> None:
        own = self.words[language]
        for w in words:
            own[w] = own.get(w, 0) + 1
        if len(own) > 200_000:
            self.settle()

    def settle(self) -> None:
        for n, own in enumerate(self.words):
            for w, k in own.items():
                np.add.at(self.counts[:, n], features(w), k)
            own.clear()


def _counted(batches: Iterator[pa.RecordBatch], add) -> Iterator[pa.RecordBatch]:
    counter = Counter()
    for b in batches:
        add(b, counter)
    counter.settle()
    bucket, language = np.nonzero(counter.counts)
    yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(counter.counts[bucket, language])], names=["bucket", "language", "n"])


def _collected(counts: DataFrame) -> np.ndarray:
    """At most BUCKETS x languages numbers, whatever the corpus."""
    out = np.zeros((BUCKETS, len(LANGUAGES)))
    summed = counts.groupBy("bucket", "language").agg(F.sum("n").alias("n")).toPandas()
    out[summed["bucket"].to_numpy(), summed["language"].to_numpy()] = summed["n"].to_numpy()
    return out


def declared(label: Column) -> Column:
    """The position in LANGUAGES of the language that a label names, null if it names none."""
    bare = F.translate(F.lower(F.trim(label)), "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy")
    bare = F.regexp_extract(bare, "^([a-z]+)", 1)
    out = F.lit(None).cast("int")
    for n, code in enumerate(LANGUAGES):
        out = F.when(bare.isin(LABELS[code]), F.lit(n)).otherwise(out)
    return out


def trained(texts: DataFrame) -> np.ndarray:
    """The log-probability table, from ``doc, label, text`` of at most about ``TRAIN_DOCUMENTS`` labelled documents.

    A first table is counted from the labels as they are; with it every stretch
    of the sample is read, and those that clearly prefer one language are
    counted anew under it. Counting combines within each task, so a task sends
    at most one number per bucket and language.
    """
    labelled = texts.where("label is not null")
    scale = 1 << 30
    share = min(1.0, TRAIN_DOCUMENTS / max(1, labelled.count()))
    texts = labelled.where(F.pmod(F.xxhash64("doc"), F.lit(scale)) < int(share * scale))
    if share < 1:
        texts = materialize(texts.select("label", "text"), "language-sample")

    def by_label(b: pa.RecordBatch, counter: Counter) -> None:
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for s in stretches(text, fold=False):
                counter.add(s, label)

    rows = texts.select("label", "text")
    first = log_table(_collected(rows.mapInArrow(lambda x: _counted(x, by_label), "bucket int, language int, n double")))
    held = rows.sparkSession.sparkContext.broadcast(first)

    def by_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(held.value)

        def add(b: pa.RecordBatch, counter: Counter) -> None:
            for text in b.column(1).to_pylist():
                for s in stretches(text, fold=False):
                    if len(s) >= SENTENCE_WORDS:
                        v = score.each(s).sum(axis=0)
                        best = int(v.argmax())
                        if v[best] - np.partition(v, -2)[-2] >= TEACH_MARGIN:
                            counter.add(s, best)

        yield from _counted(batches, add)

    second = log_table(_collected(rows.mapInArrow(by_table, "bucket int, language int, n double")))
    held.unpersist()
    return second


def _counts(docs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per key the number of documents of each main language, as an array; broadcast if there are few keys."""
    counted = docs.where("main is not null").groupBy(*keys).agg(F.array(*[F.count_if(F.col("main") == i).cast("double") for i in range(len(LANGUAGES))]).alias(name))
    return bounded_lookup(counted)


def log_priors(own: np.ndarray, overall: np.ndarray, suffix: np.ndarray, host: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Log shares of the languages expected of each document, from counts (one row per document; ``overall`` one row for all).

    A hierarchy: a host's share within a suffix is smoothed towards the
    suffix's, that towards the share of all documents, each with the strength
    of ``SMOOTHING`` documents; what documents of the same declared label are
    adds its own factor, smoothed towards all. ``own``: the document's own main
    language (1 in its column), which is left out everywhere.
    """
    def shares(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
        rest = np.maximum(counts - own, 0.0)
        return (rest + SMOOTHING * parent) / (rest.sum(axis=1, keepdims=True) + SMOOTHING)

    rest = np.maximum(overall[None, :] - own, 0.0) + 1.0
    all_ = rest / rest.sum(axis=1, keepdims=True)
    by_suffix = shares(suffix, all_)
    return np.log(shares(host, by_suffix)) + np.log(shares(label, all_)) - np.log(all_)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def identified(documents: DataFrame, *, doc: Column, text: Column, label: Column, host: Column, address: Column) -> DataFrame:
    """``(doc, label, languages, stretches)`` for every document.

    ``label``: position of the declared language or null; ``languages``: array
    of (language, confidence), the languages in which the document has at
    least one sentence, empty if it has none; ``stretches``: array of (words,
    language, confidence) in reading order. ``host``: the source of the
    document, ``address``: its URL. Null and empty texts have no stretches;
    rows with a null id are left out; any other column may be null.

    The texts are read once, after the model is fitted on a bounded sample
    (:func:`trained`). The likelihood of a stretch is fused with what the
    document declares, the suffix of its address and its host, whose shares of
    languages are counted over all documents (:func:`log_priors`).
    """
    # Declared language, suffix and host are kept with the compact scores; texts are never shuffled.
    suffix = F.regexp_extract(F.regexp_extract(address, r"^[a-zA-Z]+://([^/?#:]+)", 1), r"\.([a-zA-Z]+)$", 1)
    rows = documents.where(doc.isNotNull()).select(doc.cast("bigint").alias("doc"), declared(label).alias("label"), F.coalesce(host, F.lit("")).alias("host"), F.lower(F.coalesce(suffix, F.lit(""))).alias("suffix"), text.alias("text"))
    held = rows.sparkSession.sparkContext.broadcast(trained(rows))
    k = len(LANGUAGES)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            per_doc = [stretches(t, fold=False) for t in b.column(4).to_pylist()]
            read = iter(scorer.read([s for d in per_doc for s in d]))
            parts = [[p for _ in d for p in next(read)] for d in per_doc]
            flat = [p for d in parts for p in d]
            ll = np.array([v for _, v in flat]).reshape(-1, k)
            sums = [sum((v for n, v in d if n >= SENTENCE_WORDS), np.zeros(k)) for d in parts]
            main = [int(v.argmax()) if any(n >= SENTENCE_WORDS for n, _ in d) else None for d, v in zip(parts, sums, strict=True)]
            ends = np.cumsum([0, *[len(d) for d in parts]]).astype(np.int32)
            words = pa.ListArray.from_arrays(ends, pa.array([n for n, _ in flat], pa.int32()))
            scores = pa.ListArray.from_arrays(ends * k, pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(main, pa.int32()), words, scores], names=["doc", "label", "host", "suffix", "main", "words", "ll"])

    scored = materialize(rows.mapInArrow(score, "doc bigint, label int, host string, suffix string, main int, words array<int>, ll array<double>"), "language-scores")
    docs = scored.select("label", "host", "suffix", "main")
    overall = np.zeros(k)
    for r in docs.where("main is not null").groupBy("main").count().collect():
        overall[r["main"]] = r["count"]
    none = F.array(*[F.lit(0.0)] * k)
    fused = scored.join(_counts(docs, ["suffix", "host"], "h"), ["suffix", "host"], "left").join(_counts(docs, ["suffix"], "x"), "suffix", "left").join(_counts(docs.where("label is not null"), ["label"], "d"), "label", "left")
    fused = fused.select("doc", "label", "main", "words", "ll", *[F.coalesce(c, none).alias(c) for c in ("h", "x", "d")])

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("language", pa.int32()), ("confidence", pa.float64())])
        triple = pa.struct([("words", pa.int32()), ("language", pa.int32()), ("confidence", pa.float64())])
        for b in batches:
            main = b.column(2).to_pylist()
            counts = [b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) for c in (5, 6, 7)]
            own = np.zeros((b.num_rows, k))
            for i, m in enumerate(main):
                if m is not None:
                    own[i, m] = 1.0
            prior = log_priors(own, overall, counts[1], counts[0], counts[2])
            lengths = b.column(3).value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(b.num_rows), lengths)
            n = b.column(3).flatten().to_numpy(zero_copy_only=False)
            lp = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total = np.zeros((b.num_rows, k))
            np.add.at(total, of[n >= SENTENCE_WORDS], lp[n >= SENTENCE_WORDS])
            lp = lp + prior[of]
            language = lp.argmax(axis=1) if len(lp) else np.zeros(0, dtype=int)
            confidence = _softmax(lp).max(axis=1) if len(lp) else np.zeros(0)
            whole = _softmax(total + prior) if b.num_rows else total
            ends = np.cumsum([0, *lengths])
            languages, read = [], []
            for i, m in enumerate(main):
                rows = range(ends[i], ends[i + 1])
                best: dict[int, float] = {}
                clear: list[int] = []
                for j in rows:
                    if n[j] >= SENTENCE_WORDS:
                        x = int(language[j])
                        best[x] = max(best.get(x, 0.0), float(confidence[j]))
                        if x not in clear and (x == m or lp[j, x] - lp[j, m] >= OTHER_MARGIN):
                            clear.append(x)
                # A document all of whose sentences are unclear keeps its main language, as sure as the whole text is.
                if not clear and m is not None:
                    clear, best = [m], {m: float(whole[i, m])} | best
                languages.append([{"language": x, "confidence": best[x]} for x in clear])
                read.append([{"words": int(n[j]), "language": int(language[j]), "confidence": float(confidence[j])} for j in rows])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(languages, pa.list_(pair)), pa.array(read, pa.list_(triple))], names=["doc", "label", "languages", "stretches"])

    return fused.mapInArrow(fuse, "doc bigint, label int, languages array<struct<language:int,confidence:double>>, stretches array<struct<words:int,language:int,confidence:double>>")


def to_correct(found: DataFrame) -> DataFrame:
    """``(doc, language, confidence)``: the rows of :func:`identified` whose label is missing, wrong or one of several languages."""
    names = F.transform("languages", lambda s: s["language"])
    case = (F.size("languages") > 0) & (F.col("label").isNull() | (F.size("languages") > 1) | ~F.coalesce(F.array_contains(names, F.col("label")), F.lit(False)))
    code = F.get(F.array(*[F.lit(c) for c in LANGUAGES]), F.col("l.language"))
    return found.where(case).select("doc", F.explode("languages").alias("l")).select("doc", code.alias("language"), F.col("l.confidence").alias("confidence"))
