"""Phrase collocation mining by contiguous pattern growth.

Texts are cut into pieces and words, and coded as numbers batch by batch; the words that are
frequent in their language get numbers of their own, the others end what can grow. A prefix's
projection holds a pointer for each of its occurrences, with the words that follow in the piece;
those of a group of prefixes travel together. One task grows a prefix to the right, depth-first: the
pointers of a frequent next word are the projection of the longer prefix, down to MOST_WORDS words. As a phrase is never more frequent
than its parts, every count that a score needs is one of a frequent phrase.

Pairs come first, from projections of one word after each prefix. A phrase of three words or more has
frequent pairs alone, so the projections that it is grown from end at the first pair that isn't, which leaves
few of them to be shuffled.

A prefix of more than MOST occurrences is no task: its next words are counted over all tasks, and
each of them that is frequent is a prefix itself, with a task or, if it is too frequent too,
one level deeper. Such prefixes are the only ones that all tasks know; there are at most
MOST_WORDS - 1 times occurrences / MOST of them, and MOST rises with the occurrences so that this is
4 million at most. Equal pointers of a batch travel as one, with their number.

A phrase lies in a longer one of equal count if and only if it lies in one that has a word more, since
counts between the two are equal too; so one level up decides what is dropped.

Cases: a null text has no words; a null language is `und`; a text without words adds nothing; repeated
rows count each time; a text of any length is read whole, in slices between words, but the words of
one piece, the text between two marks, are held together; ties of scores go by count and phrase; a
table without frequent words gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup, read, small_batches, written

LEAST = 100
MOST_WORDS = 5
TOP = 2000
#: Occurrences of a prefix that one task grows, words that are coded together, characters that are split at once.
MOST, BATCH_WORDS, SLICE = 1_000_000, 1 << 18, 1 << 18
MOST_HOT = 1_000_000
#: Groups of prefixes whose projections travel together, and words of the corpus for each where that makes more; every prefix is grown by itself.
GROUPS, GROUP_WORDS = 1024, 2_000_000
#: Frequent words that all tasks may know, some 30 MB; where there are more, batches' words are joined with them.
MOST_SENT = 1_000_000
#: Frequent pairs that all tasks may know, 64 MB; where there are more, no occurrence goes before the shuffle.
MOST_PAIRS = 4_000_000

_MARK = "\n"
_FOLDED = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)} | dict.fromkeys(".,;:!?\x0b\x0c\r", _MARK) | {"\t": " "})
_EDGE = re.compile("[ \n]")


def _slices(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        edge = _EDGE.search(text, start + SLICE)
        end = edge.start() if edge else len(text)
        yield text[start:end]
        start = end


def _planes(numbers: np.ndarray) -> bytes:
    """int32 numbers, all first bytes first: the upper ones are mostly zero, which any compression makes short."""
    return np.ascontiguousarray(numbers, dtype="<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes | pa.Buffer) -> np.ndarray:
    own = np.frombuffer(planes, dtype=np.uint8)
    return np.ascontiguousarray(own.reshape(4, -1).T).view("<i4").ravel()


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(_planes(numbers))


def _unpacked(packed: pa.Scalar) -> np.ndarray:
    return _numbers(zstandard.ZstdDecompressor().decompress(packed.as_buffer()))


class _Coder:
    """The words of one language, until they fill a batch; pieces stay whole."""

    def __init__(self):
        self.held, self.n = [], 0

    def add(self, texts: list[str]) -> None:
        for part in _slices(_MARK + _MARK.join(texts).translate(_FOLDED)):
            words = pa.array([w for w in part.replace(_MARK, f" {_MARK} ").split(" ") if w], pa.string())
            self.held.append(words.dictionary_encode())
            self.n += len(words)

    def batch(self, rest: bool) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
        """Words, their counts, and codes with -1 between pieces. rest: all that is held, else up to the last mark."""
        if not self.held:
            return None
        whole = pa.chunked_array(self.held).unify_dictionaries()
        words, codes = whole.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in whole.chunks])
        mark = pc.index(words, _MARK).as_py()
        end = len(codes) if rest else int(np.flatnonzero(codes == mark)[-1]) if mark >= 0 else 0
        if not end:
            return None
        left = words.take(pa.array(codes[end:]))
        self.held, self.n = ([left.dictionary_encode()] if len(left) else []), len(left)
        used, codes = np.unique(codes[:end], return_inverse=True)
        at = np.cumsum(used != mark) - 1
        codes = np.where(used == mark, -1, at)[codes].astype(np.int32)
        words = words.take(pa.array(used[used != mark]))
        return words, np.bincount(codes[codes >= 0], minlength=len(words)), codes


_CODED = "batch string, lang string, words array<string>, counts array<long>, codes binary"


def coded(docs: DataFrame, text: str = "text", lang: str = "lang", batch_words: int = BATCH_WORDS) -> DataFrame:
    """A row per batch of words of one language."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[str, _Coder] = {}
        part, k = TaskContext.get().partitionId(), 0

        def flush(own: str, rest: bool) -> Iterator[pa.RecordBatch]:
            nonlocal k
            if found := coders[own].batch(rest):
                words, counts, codes = found
                lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(counts, pa.int64()))]
                yield pa.record_batch([pa.array([f"{part}-{k}"]), pa.array([own]), *lists, pa.array([_packed(codes)])], names=["batch", "lang", "words", "counts", "codes"])
                k += 1

        for b in batches:
            langs = np.array(b.column(1).to_pylist(), dtype=object)
            texts = b.column(0).to_pylist()
            for own in dict.fromkeys(langs):
                coders.setdefault(own, _Coder()).add([texts[i] for i in np.flatnonzero(langs == own)])
                if coders[own].n >= batch_words:
                    yield from flush(own, False)
        for own in coders:
            yield from flush(own, True)

    own = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    return own.mapInArrow(run, _CODED)


def _numbered(words: DataFrame) -> DataFrame:
    """words, a table, with id: numbers from 0 without large gaps, an int."""
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    own = written(words.withColumns({"part": part, "place": place}))
    sizes = sorted((r[0], r[1]) for r in own.groupBy("part").count().collect())  # a number per task
    starts = np.cumsum([0, *[n for _, n in sizes]])
    before = own.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, starts, strict=False)], "part int, before long")
    return own.join(F.broadcast(before), "part").select(*words.columns, (F.col("before") + F.col("place")).cast("int").alias("id"))


def _windows(seq: np.ndarray, width: int = MOST_WORDS, most: int = 1 << 18) -> Iterator[np.ndarray]:
    """Rows of width words from each word on that another follows, -1 from the end of what can grow on."""
    padded = np.append(seq, np.full(width, -1, dtype=np.int32))
    for start in range(0, len(seq), most):
        end = min(start + most, len(seq))
        at = start + np.flatnonzero((padded[start:end] >= 0) & (padded[start + 1 : end + 1] >= 0))
        rows = np.empty((len(at), width), dtype=np.int32)
        for c in range(width):
            rows[:, c] = padded[at + c]
            if c > 1:
                rows[rows[:, c - 1] < 0, c] = -1
        yield rows


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows in order, and how often each is there. Numbers are -1 or more."""
    if not len(rows):
        return rows, np.zeros(0, dtype=np.int64)
    wide = lambda i: rows[:, i].astype(np.int64) + 1
    pairs = [wide(i) << 32 | wide(i + 1) if i + 1 < rows.shape[1] else wide(i) for i in range(0, rows.shape[1], 2)]
    order = np.lexsort(pairs[::-1])
    new = np.ones(len(rows), dtype=bool)
    new[1:] = np.any([p[order][1:] != p[order][:-1] for p in pairs], axis=0)
    starts = np.flatnonzero(new)
    return rows[order[starts]], np.diff(np.append(starts, len(rows)))


class Hot:
    """The prefixes that no task grows, as a tree: level k has the keys (place of the parent, word) of those of k + 1 words."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[list[list[int]]] = []
        self.paths: list[list[list[int]]] = []

    def add(self, found: list[tuple[list[int], list[int]]]) -> None:
        """The prefixes of one word more, each with the counts of its own prefixes and itself."""
        rows = sorted((self._key(ids), ids, counts) for ids, counts in found)
        self.keys.append(np.array([r[0] for r in rows], dtype=np.int64))
        self.paths.append([r[1] for r in rows])
        self.counts.append([r[2] for r in rows])

    def _key(self, ids: list[int]) -> int:
        place = 0
        for keys, word in zip(self.keys, ids, strict=False):
            place = int(np.searchsorted(keys, place << 32 | word))
        return place << 32 | ids[-1]

    def depth(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words of each row are a hot prefix, and its place."""
        depth, place = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        alive = np.arange(len(rows))
        for k, keys in enumerate(self.keys[: rows.shape[1]]):
            if not len(keys) or not len(alive):
                break
            key = place[alive] << 32 | rows[alive, k]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (keys[at] == key) & (rows[alive, k] >= 0)
            alive, at = alive[hit], at[hit]
            depth[alive], place[alive] = k + 1, at
        return depth, place


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    if not len(keys):
        return
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    for b in batches:
        for lang, seq in zip(b.column("lang"), b.column("seq"), strict=True):
            yield lang.as_py(), _unpacked(seq)


_PHRASE = "lang string, ids array<int>, counts array<long>"


def _children(sequences: DataFrame, hot: Hot, k: int, least: int) -> DataFrame:
    """The frequent phrases of k + 1 words whose first k are hot, counted over all tasks."""
    sent = sequences.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, seq in _sequences(batches):
            for rows in _windows(seq):
                depth, place = sent.value.depth(rows)
                own = (depth == k) & (rows[:, k] >= 0)
                found, n = _grouped(np.column_stack([place[own], rows[own, k]]).astype(np.int32))
                yield pa.record_batch([pa.array([lang] * len(n), pa.string()), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(n)], names=["lang", "parent", "next", "n"])

    counted = sequences.mapInArrow(run, "lang string, parent int, next int, n long").groupBy("lang", "parent", "next").agg(F.sum("n").alias("n")).where(F.col("n") >= least)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, counts = sent.value.paths[k - 1], sent.value.counts[k - 1]
        for b in batches:
            parents, nexts, n = (b.column(c).to_pylist() for c in ("parent", "next", "n"))
            ids, all_counts = [[*paths[p], x] for p, x in zip(parents, nexts, strict=True)], [[*counts[p], x] for p, x in zip(parents, n, strict=True)]
            yield pa.record_batch([b.column("lang"), pa.array(ids, pa.list_(pa.int32())), pa.array(all_counts, pa.list_(pa.int64()))], names=["lang", "ids", "counts"])

    return counted.mapInArrow(named, _PHRASE)


def grow(rows: np.ndarray, n: np.ndarray, prefix: list[int], counts: list[int], least: int, shortest: int) -> Iterator[tuple[list[int], list[int]]]:
    """The frequent phrases of shortest words or more that continue prefix: their words, and the counts of their prefixes and themselves.

    rows: the words after each occurrence, -1 from where nothing follows; n: how often each row is there.
    """

    def extend(pointers: np.ndarray, depth: int, prefix: list[int], counts: list[int]) -> Iterator[tuple[list[int], list[int]]]:
        if depth == rows.shape[1]:
            return
        words = rows[pointers, depth]
        pointers, words = pointers[words >= 0], words[words >= 0]
        order = np.argsort(words, kind="stable")
        pointers, words = pointers[order], words[order]
        ends = np.concatenate([[0], np.cumsum(n[pointers])])
        starts = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, dtype=np.int64)
        stops = np.append(starts[1:], len(words))
        sums = ends[stops] - ends[starts] if len(starts) else starts
        for i in np.flatnonzero(sums >= least):
            longer, with_own = [*prefix, int(words[starts[i]])], [*counts, int(sums[i])]
            if len(longer) >= shortest:
                yield longer, with_own
            yield from extend(pointers[starts[i] : stops[i]], depth + 1, longer, with_own)

    yield from extend(np.arange(len(rows)), 0, prefix, counts)


class Pairs:
    """The frequent phrases of two words, and their counts."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        keys = ids[:, 0].astype(np.int64) << 32 | ids[:, 1]
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The counts; 0 for pairs that aren't frequent."""
        if not len(self.keys):
            return np.zeros(len(first), dtype=np.int64)
        keys = first.astype(np.int64) << 32 | second
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (second >= 0), self.counts[at], 0)

    def cut(self, rows: np.ndarray) -> np.ndarray:
        """The rows of three words or more, each up to its first pair that isn't frequent."""
        for c in range(1, rows.shape[1]):
            gone = rows[:, c] >= 0
            gone[gone] = self.of(rows[gone, c - 1], rows[gone, c]) == 0
            rows[gone, c:] = -1
            if c < 3:
                rows = rows[rows[:, c] >= 0]
        return rows


def _projected(sequences: DataFrame, hot: Hot, most: int, groups: int, width: int = MOST_WORDS, pairs: Broadcast | None = None) -> DataFrame:
    """A row per batch and task: lang, depth, root, share, rows (packed columns of words, and how often each row is there).

    width: words of a row. pairs: only rows of three words or more are wanted, up to the first pair that isn't frequent.

    depth 0: occurrences of prefixes that aren't hot, from their first word on; root is one of
    so many groups of such prefixes. Else root is the place of the longest hot prefix, of depth
    words, and rows begin after it; they are dealt by the next word into as many shares as
    keep each small.
    """
    sent = sequences.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = [np.array([1 + 2 * c[-1] // most for c in counts], dtype=np.int64) for counts in sent.value.counts]
        for lang, seq in _sequences(batches):
            for window in _windows(seq, width):
                rows, n = _grouped(pairs.value.cut(window) if pairs else window)
                depth, place = sent.value.depth(rows)
                for d in range(width - 1):
                    own = np.flatnonzero((depth == d) & (rows[:, max(d, 1)] >= 0))
                    root = place[own] if d else rows[own, 0].astype(np.int64) % groups
                    share = rows[own, d] % shares[d - 1][root] if d and len(own) else np.zeros(len(own), dtype=np.int64)
                    order = np.lexsort((share, root))
                    own, root, share = own[order], root[order], share[order]
                    body = np.column_stack([rows[own, d:], n[own].astype(np.int32)])
                    at = list(_runs(root << 16 | share))
                    for some in range(0, len(at), 256):
                        part = at[some : some + 256]
                        first = [s for s, _ in part]
                        packed = pa.array([_packed(body[s:e].T) for s, e in part], pa.binary())
                        yield pa.record_batch([pa.array([lang] * len(part), pa.string()), pa.array(np.full(len(part), d, dtype=np.int32)), pa.array(root[first].astype(np.int32)), pa.array(share[first].astype(np.int32)), packed], names=["lang", "depth", "root", "share", "rows"])

    return sequences.mapInArrow(run, "lang string, depth int, root int, share int, rows binary")


def _translated(batches: DataFrame, words: DataFrame, send: bool) -> DataFrame:
    """(lang, seq): batches in the numbers of frequent words, -1 for what ends a phrase."""

    def row(lang: str, packed: pa.Scalar, at: np.ndarray, id: np.ndarray) -> pa.RecordBatch:
        codes = _unpacked(packed)
        table = np.full(int(codes.max(initial=-1)) + 2, -1, dtype=np.int32)  # the last is for the code -1
        table[at] = id
        return pa.record_batch([pa.array([lang], pa.string()), pa.array([_packed(table[codes])])], names=["lang", "seq"])

    if send:
        known = {}
        for b in words.select("lang", "word", "id").toArrow().to_batches():
            langs = b.column("lang").dictionary_encode()
            for k, name in enumerate(langs.dictionary.to_pylist()):
                known.setdefault(name, []).append(b.filter(pc.equal(langs.indices, k)))
        sent = batches.sparkSession.sparkContext.broadcast({name: (pa.concat_arrays([x.column("word") for x in own]), np.concatenate([x.column("id").to_numpy() for x in own])) for name, own in known.items()})

        def look_up(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                for lang, own, codes in zip(b.column("lang").to_pylist(), b.column("words"), b.column("codes"), strict=True):
                    if lang in sent.value:
                        found, ids = sent.value[lang]
                        place = pc.index_in(own.values, value_set=found)
                        at = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                        yield row(lang, codes, at, ids[place.drop_null().to_numpy()])

        return batches.select("lang", "words", "codes").mapInArrow(look_up, "lang string, seq binary")

    places = batches.select("batch", "lang", F.posexplode("words").alias("at", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    meanings = places.groupBy("batch").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("id"))

    def put_in(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i, lang in enumerate(b.column("lang").to_pylist()):
                yield row(lang, b.column("codes")[i], b.column("at")[i].values.to_numpy(), b.column("id")[i].values.to_numpy())

    return batches.select("batch", "lang", "codes").join(meanings, "batch").mapInArrow(put_in, "lang string, seq binary")


def _grown(projected: DataFrame, hot: Hot, width: int, least: int, shortest: int = 2, pairs: Broadcast | None = None) -> DataFrame:
    """The frequent phrases of projections of width words, of shortest words or more, one task per row of prefixes."""
    sent = projected.sparkSession.sparkContext.broadcast(hot)

    def own_task(key: tuple, table: pa.Table) -> pa.Table:
        lang, depth, root, _ = (x.as_py() for x in key)
        body = np.concatenate([_unpacked(x).reshape(width - depth + 1, -1) for c in table["rows"].chunks for x in c], axis=1).T
        out = []
        if depth:
            out += grow(body[:, :-1], body[:, -1].astype(np.int64), sent.value.paths[depth - 1][root], sent.value.counts[depth - 1][root], least, max(depth + 2, shortest))
        else:
            body = body[np.argsort(body[:, 0], kind="stable")]
            for s, e in _runs(body[:, 0]):
                out += grow(body[s:e, 1:-1], body[s:e, -1].astype(np.int64), [int(body[s, 0])], [0], least, shortest)
        if pairs and out:  # their rows are those of longer phrases alone
            own = pairs.value.of(np.array([x[0] for x, _ in out]), np.array([x[1] for x, _ in out]))
            out = [(x, [c[0], int(n), *c[2:]]) for (x, c), n in zip(out, own, strict=True)]
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "ids": pa.array([x for x, _ in out], pa.list_(pa.int32())), "counts": pa.array([x for _, x in out], pa.list_(pa.int64()))})

    return projected.groupBy("lang", "depth", "root", "share").applyInArrow(own_task, _PHRASE)


def frequent(docs: DataFrame, least: int = LEAST, most: int = MOST, text: str = "text", lang: str = "lang", batch_words: int = BATCH_WORDS, most_sent: int = MOST_SENT, most_pairs: int = MOST_PAIRS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases of two words or more (lang, ids, counts of their prefixes and themselves), frequent words (lang, word, n, id), and all words' number by language (lang, n)."""
    spark = docs.sparkSession
    batches = written(coded(docs, text, lang, batch_words))
    every = batches.select("lang", F.inline(F.arrays_zip("words", "counts"))).groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("n"))
    totals = written(batches.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")))
    words = written(_numbered(every.where(F.col("n") >= least).orderBy(F.desc("n"), "lang", "word")))  # small numbers for frequent words
    total = totals.agg(F.sum("n")).first()[0] or 0
    most, groups = max(most, total // MOST_HOT), min(max(GROUPS, total // GROUP_WORDS), 1 << 20)

    sequences = written(_translated(batches, words, words.count() <= most_sent))

    hot, found = Hot(), []
    hot.add([([r.id], [r.n]) for r in words.where(F.col("n") > most).collect()])
    for k in range(1, MOST_WORDS):
        if not len(hot.keys[k - 1]):
            break
        found.append(written(_children(sequences, hot, k, least)))
        if k + 1 < MOST_WORDS:
            hot.add([(r.ids, r.counts) for r in found[-1].where(F.element_at("counts", -1) > most).collect()])

    # phrases of two words first; what is longer has frequent pairs alone, so most occurrences go before they are shuffled
    two = written(_grown(_projected(sequences, hot, most, groups, 2), hot, 2, least))
    found.append(two)
    every_two = two if len(found) == 1 else two.unionByName(found[0])
    known = None
    if every_two.count() <= most_pairs:
        table = every_two.select("ids", F.element_at("counts", -1).alias("n")).toArrow()
        known = spark.sparkContext.broadcast(Pairs(table["ids"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2), table["n"].to_numpy()))
    grown = _grown(_projected(sequences, hot, most, groups, MOST_WORDS, known), hot, MOST_WORDS, least, 3, known)
    alone = words.select(F.col("id").alias("first"), F.col("n").alias("alone"))
    for more in found:
        grown = grown.unionByName(more)
    grown = written(grown)  # tasks of single words don't know how often theirs is there
    grown = lookup(grown.withColumn("first", F.element_at("ids", 1)), alone, ["first"], ["ids"], "inner")
    return written(grown.select("lang", "ids", F.concat(F.array("alone"), F.slice("counts", 2, MOST_WORDS)).alias("counts"))), words, totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases."""
    found, words, totals = frequent(docs, least, **options)
    big = lambda c: F.col(c).cast("decimal(20,0)")

    known = found.select("ids", F.element_at("counts", -1).alias("r")).unionAll(words.select(F.array("id").alias("ids"), F.col("n").alias("r"))).withColumnRenamed("ids", "rest")
    cuts = found.select("lang", "ids", "counts", F.element_at("counts", -1).alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("lang", "ids", "a", "k", F.get("counts", F.col("k") - 1).alias("l"), F.expr("slice(ids, k + 1, size(ids))").alias("rest"))
    cuts = lookup(lookup(cuts, known, ["rest"], ["ids"], "inner"), totals, ["lang"], ["ids"], "inner")
    scored = cuts.withColumn("score", score(*map(big, ("a", "n", "l", "r"))))
    best = written(scored.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.max(F.when(F.col("k") == 1, F.col("r"))).alias("tail"), F.max(F.when(F.col("k") == F.size("ids") - 1, F.col("l"))).alias("head")))

    shorter = F.concat(F.when(F.col("head") == F.col("a"), F.array(F.slice("ids", 1, F.size("ids") - 1))).otherwise(F.array()), F.when(F.col("tail") == F.col("a"), F.array(F.expr("slice(ids, 2, size(ids))"))).otherwise(F.array()))
    inside = best.where("size(ids) > 2").select(F.explode(shorter).alias("ids")).distinct()
    kept = best.join(inside, "ids", "left_anti").select("lang", "ids", "a", "n", "cut.*")

    first = kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top)
    named = first.select("*", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    whole = named.groupBy("lang", "ids", "a", "l", "r", "n", "score").agg(phrase.alias("phrase"))
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) of decimal(20,0) columns, exact while 1000 * a * n has 38 digits at most; it is a long."""
    thousand = F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", (thousand * a * n).cast("decimal(38,0)"), (l * r).cast("decimal(38,0)"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = rf"""
with p as (
  select row_number() over () as piece, lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda x: x <> '') as w
  from (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)
), totals as (
  select lang, sum(len(w))::hugeint as n from p group by lang
), f as (
  select lang, ids, count(*)::hugeint as f from (
    select lang, w[i : i + k - 1] as ids from (select lang, w, unnest(range(1, len(w) + 1)) as i from p), unnest(range(1, {MOST_WORDS + 1})) r(k) where i + k - 1 <= len(w)
  ) group by lang, ids having count(*) >= {LEAST}
), c as (
  select lang, ids, f as a from f where len(ids) > 1
), cuts as (
  select c.lang, c.ids, c.a, k, x.f as l, y.f as r, totals.n, (1000 * c.a * totals.n) // (x.f * y.f) as score
  from c, unnest(range(1, len(c.ids))) t(k) join totals on totals.lang = c.lang
  join f x on x.lang = c.lang and x.ids = c.ids[1 : k] join f y on y.lang = c.lang and y.ids = c.ids[k + 1 :]
), best as (
  select * from cuts qualify row_number() over (partition by lang, ids order by score, k) = 1
), inside as (
  select distinct lang, part from (select lang, a, ids, unnest(range(1, len(ids))) as i from c), unnest(range(2, {MOST_WORDS})) r(k), unnest([ids[i : i + k - 1]]) s(part), (select lang as other, ids as short, f from f)
  where i + k - 1 <= len(ids) and k < len(ids) and other = lang and short = part and 100 * a >= 100 * f
)
select lang, row_number() over w as rank, array_to_string(ids, ' ') as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from best where not exists (select 1 from inside where inside.lang = best.lang and part = ids)
window w as (partition by lang order by score desc, a desc, array_to_string(ids, ' '))
qualify row_number() over w <= {TOP}
"""
