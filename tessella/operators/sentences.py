"""Sentence boundaries learned from the corpus itself, after Kiss and Strunk (2006).

Three tests of log-likelihood, each an aggregation that combines before it shuffles: an abbreviation is a type
of word that stands with a period far more often than chance would have it, weighed down by its
length and by its uses without one, and up by periods inside; a sentence starter is a word that follows
sure ends more often than it stands elsewhere; a collocation is a pair around the period of an
abbreviation, an initial or a number that belongs together, so that nothing ends there. The words' usual
case settles the rest: a word that is mostly written small and here has a capital begins
something.

The model is all that passes the tests. A kind of at most MOST entries is held in memory, on the driver and in each
worker; of a larger one, which stays a table, what the texts at hand ask is held if it is no more than that, and else each
text gets by a join what it asks. Nothing is left out. Cases: null and
empty texts have no words and no sentences; a language may be learned by itself (`by`), null being one too; a word is what stands between
white space, without brackets and quotes around it, in lower case; numbers are one type.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.batches import small_batches
from ..sources.scratch import scratch

#: The thresholds of the published method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
NUMBER = "##number##"
#: Entries of a kind that are held in memory; more are joined.
MOST = 100_000
#: What a model knows, by kind.
KINDS = "abbreviations", "starters", "pairs", "small"

#: What may stand around a word.
_OPENING, _CLOSING = "\"'(\\[{«„“‘¿¡*_", "\"')\\]}»“”’*_"
_NUMBER = r"[-+]?[0-9][0-9.,:/%-]*"


def _core(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, f"^[{_OPENING}]+", ""), f"[{_CLOSING},;:]+\\z", "")


def _type(core: Column) -> Column:
    plain = F.regexp_replace(core, "[.!?…]+\\z", "")
    return F.when(plain.rlike(f"^{_NUMBER}\\z"), NUMBER).otherwise(F.lower(plain))


def _lang(by: Column | None) -> Column:
    return F.lit("") if by is None else F.coalesce(by.cast("string"), F.lit(""))


def words(units: DataFrame, text: str = "text", by: Column | None = None) -> DataFrame:
    """A row per different word, with its follower where it may end something: lang, n, type, period (a single one ends it), stop (an end in any case), upper, next_type, next_upper.

    Words are counted as they stand, so all but the split is done once for each different one.
    """
    lang = _lang(by)
    bare = f"^[{_OPENING}]*+[{_CLOSING},;:]*+\\z"
    split = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: ~w.rlike(bare))
    made = units.select(lang.alias("lang"), split.alias("w")).where(F.size("w") > 0)
    placed = made.select("lang", F.inline(F.arrays_zip(F.col("w").alias("word"), F.slice("w", 2, F.size("w")).alias("next"))))
    counted = placed.groupBy("lang", "word", F.when(F.col("word").rlike("[.!?…]"), F.col("next")).alias("next")).agg(F.count("*").alias("n"))
    once = lambda **own: F.inline(F.array(F.struct(*[c.alias(k) for k, c in own.items()])))  # noqa: E731  columns that later ones name often
    cores = counted.select("lang", "n", once(core=_core(F.col("word")), next=_core(F.col("next"))))
    typed = cores.select("lang", "n", "core", "next", once(type=_type(F.col("core")), next_type=_type(F.col("next"))))
    upper = lambda c: F.col(c).rlike(r"^\p{Lu}")
    found = typed.select("lang", "n", "type", F.col("core").rlike(r"(^|[^.])\.\z").alias("period"), F.col("core").rlike(r"([!?…]|\.\.)\z").alias("stop"), upper("core").alias("upper"), "next_type", upper("next").alias("next_upper"))
    return found.where("type <> ''")


def _ln(x: Column) -> Column:
    return F.ln(F.greatest(x, F.lit(1e-12)))


def likelihood(both: Column, first: Column, second: Column, total: Column) -> Column:
    """How much better two rates explain `both` of `first` than one; 0 if the pair is rarer than chance."""
    far = lambda k, m, p: k * _ln(p) + (m - k) * _ln(1 - p)
    rest = F.greatest(total - first, F.lit(1))
    p, p1, p2 = second / total, both / first, F.greatest(second - both, F.lit(0)) / rest
    more = -2 * (far(both, first, p) + far(second - both, rest, p) - far(both, first, p1) - far(second - both, rest, p2))
    return F.when(p1 > p2, F.greatest(more, F.lit(0.0))).otherwise(F.lit(0.0))


def type_counts(found: DataFrame) -> DataFrame:
    """lang, type, n, n_period, n_upper, n_lower of words()."""
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return found.groupBy("lang", "type").agg(F.sum("n").alias("n"), count(F.col("period")).alias("n_period"), count(F.col("upper")).alias("n_upper"), count(~F.col("upper")).alias("n_lower"))


def scored_types(counts: DataFrame) -> DataFrame:
    """type_counts() with `score`, from ABBREVIATION on that of an abbreviation."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("n_period").alias("periods"))
    c = counts.where("n_period > 0").join(F.broadcast(totals), "lang")  # a row a language
    k, n, p = F.col("n_period"), F.col("n"), F.col("periods") / F.col("total")
    null = k * _ln(p) + (n - k) * _ln(1 - p)
    sure = k * _ln(F.lit(0.99)) + (n - k) * _ln(F.lit(0.01))
    inside = F.char_length("type") - F.char_length(F.replace("type", F.lit("."), F.lit("")))
    size = F.char_length("type") - inside
    score = -2 * (null - sure) * F.exp(-size.cast("double")) * (inside + 1) * F.pow(F.greatest(size, F.lit(1)).cast("double"), -(n - k))
    known = F.col("type").rlike(r"\p{L}")
    return c.withColumn("score", F.when(known, score).otherwise(F.lit(0.0))).drop("total", "periods")


class Boundaries:
    """What is known of each language: abbreviations, starters, collocations and words that are mostly small.

    `tables` has the kinds that are too large to be held: lang, type and next_type ('' but for pairs).
    """

    def __init__(self, abbreviations: set[tuple[str, str]], starters: set[tuple[str, str]], pairs: set[tuple[str, str, str]], small: set[tuple[str, str]], tables: dict[str, DataFrame] | None = None, most: int = MOST):
        self.abbreviations, self.starters, self.pairs, self.small = abbreviations, starters, pairs, small
        self.tables, self.most = tables or {}, most
        self.unknown = frozenset(self.tables)

    def held(self) -> Boundaries:
        """What goes to the workers: without the tables, whose kinds ends() refuses to do without."""
        out = Boundaries(self.abbreviations, self.starters, self.pairs, self.small)
        out.unknown = self.unknown
        return out

    def told(self, entries: Iterable[Sequence[str]] | None, lang: str | None = None) -> Boundaries:
        """The model for one text: its entries (kind, type, next_type) stand for the kinds that aren't held."""
        if not self.unknown:
            return self
        own: dict[str, set] = {kind: set() for kind in self.unknown}
        for kind, *names in entries if entries is not None else ():
            own[kind].add((lang or "", *names[: 2 if kind == "pairs" else 1]))
        return Boundaries(**{kind: own.get(kind, getattr(self, kind)) for kind in KINDS})

    def asks(self, text: str | None, lang: str | None = None) -> list[tuple[str, str, str]]:
        """All that ends() may look up in text of the kinds that aren't held, each once: kind, type, next_type."""
        lang, out = lang or "", set()
        for _, core, following in _marks(text or ""):
            if core[-1] != "." or core.endswith("..") or following[:1].islower():
                continue
            kind, then, upper = _kind(core), _kind(following), following[:1].isupper()
            if "abbreviations" in self.unknown:
                out.add(("abbreviations", kind, ""))
            elif not ((lang, kind) in self.abbreviations or _initial(kind) or kind == NUMBER):
                continue
            if upper:
                out.update((k, kind, then) if k == "pairs" else (k, then, "") for k in self.unknown if k != "abbreviations")
        return sorted(out)

    def ends(self, text: str, lang: str | None = None) -> list[int]:
        """Where sentences end in text: after the word and before the white space that follows."""
        if self.unknown:
            raise ValueError(f"too large to be held: {', '.join(sorted(self.unknown))}; sentences() and sentence_chunk_rows() join them")
        lang, out = lang or "", []
        for end, core, following in _marks(text):
            upper = following[:1].isupper()
            if core[-1] != "." or core.endswith(".."):
                if core[-1] != "." or upper:
                    out.append(end)
                continue
            kind, then = _kind(core), _kind(following)
            initial = _initial(kind)
            if (lang, kind) in self.abbreviations or initial or kind == NUMBER:
                if (lang, kind, then) in self.pairs or not upper:
                    continue
                starts = (lang, then) in self.starters or (lang, then) in self.small
                if starts and not (initial and (lang, then) not in self.small):
                    out.append(end)
                elif kind == NUMBER and not starts and (lang, kind) not in self.abbreviations:
                    out.append(end)
            elif upper or not following[:1].islower():
                out.append(end)
        return out

    def split(self, text: str | None, lang: str | None = None) -> list[str]:
        """The sentences of text, without white space around them."""
        if not text:
            return []
        at = [0, *self.ends(text, lang), len(text)]
        return [s for a, b in zip(at, at[1:], strict=False) if (s := text[a:b].strip())]


#: The end of a word that may end a sentence, and the word that follows.
_MARKED = re.compile(f"[.!?…。？！][{_CLOSING},;:]*+(?=\\s++(\\S++))")
_STRIP = re.compile(f"^[{_OPENING}]+|[{_CLOSING},;:]+$")
_ENDS = re.compile(r"[.!?…]+$")
_IS_NUMBER = re.compile(f"{_NUMBER}$")


def _strip(word: str) -> str:
    return _STRIP.sub("", word)


def _kind(core: str) -> str:
    plain = _ENDS.sub("", core).lower()
    return NUMBER if _IS_NUMBER.match(plain) else plain


def _initial(kind: str) -> bool:
    return len(kind) == 1 and kind.isalpha()


def _marks(text: str) -> Iterator[tuple[int, str, str]]:
    """The words that may end a sentence: where each ends, the word and the one that follows, both bare."""
    low = 0
    for m in _MARKED.finditer(text):
        core = _strip(text[low : m.end()].rsplit(None, 1)[-1])
        low = m.end()
        yield low, core, _strip(m[1])


def _written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables(units: DataFrame, text: str = "text", by: Column | None = None) -> dict[str, DataFrame]:
    """The model as tables: types (with their scores), starters and pairs.

    The texts are read once: all tables come from the words' counts, which are written.
    """
    found = _written(words(units, text, by))
    counts = _written(type_counts(found))
    types = scored_types(counts)
    abbreviated = types.where(F.col("score") >= ABBREVIATION).select("lang", "type", F.lit(True).alias("short"))
    initial = F.col("type").rlike(r"^\p{L}\z") | (F.col("type") == NUMBER)
    # pairs around ends, combined before they meet the abbreviations
    ends = found.where("(period or stop) and next_type <> ''").groupBy("lang", "type", "period", "next_type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("next_upper"), F.col("n")).otherwise(0)).alias("n_upper"))
    marked = ends.join(abbreviated, ["lang", "type"], "left").withColumn("doubtful", F.col("period") & (F.coalesce("short", F.lit(False)) | initial))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    plain = counts.select("lang", F.col("type").alias("next_type"), F.col("n").alias("n_next"))

    sure = marked.where("not doubtful").groupBy("lang", "next_type").agg(F.sum("n_upper").alias("n_after"))
    breaks = marked.where("not doubtful").groupBy("lang").agg(F.sum("n").alias("breaks"))
    starters = sure.join(plain, ["lang", "next_type"]).join(F.broadcast(breaks), "lang").join(F.broadcast(totals), "lang")
    starters = starters.withColumn("score", likelihood(F.col("n_after"), F.col("breaks"), F.col("n_next"), F.col("total"))).where(F.col("next_type").rlike(r"^\p{L}"))
    starters = starters.select("lang", F.col("next_type").alias("type"), "n_after", F.col("n_next").alias("n"), "score")

    pairs = marked.where("doubtful").groupBy("lang", "type", "next_type").agg(F.sum("n").alias("n_both"))
    pairs = pairs.join(counts.select("lang", "type", F.col("n").alias("n_first")), ["lang", "type"]).join(plain, ["lang", "next_type"]).join(F.broadcast(totals), "lang")
    pairs = pairs.withColumn("score", likelihood(F.col("n_both"), F.col("n_first"), F.col("n_next"), F.col("total"))).where("n_both > 1").select("lang", "type", "next_type", "n_both", "score")
    return {"counts": counts, "types": types, "starters": starters, "pairs": pairs}


def learn(units: DataFrame, text: str = "text", by: Column | None = None, most: int = MOST) -> Boundaries:
    """The whole model; kinds of more than `most` entries stay tables."""
    made = tables(units, text, by)
    scored = {"abbreviations": ("types", ABBREVIATION), "starters": ("starters", STARTER), "pairs": ("pairs", COLLOCATION)}
    passed = {kind: made[name].where(F.col("score") >= least) for kind, (name, least) in scored.items()}
    passed["small"] = made["counts"].where("n_lower > 2 * n_upper and n >= 3")
    held, large = {}, {}
    for kind, df in passed.items():
        named = df.select("lang", "type", *(["next_type"] if kind == "pairs" else []))
        rows = named.limit(most + 1).collect()  # one more shows that they don't fit
        held[kind] = {tuple(r) for r in rows} if len(rows) <= most else set()
        if len(rows) > most:
            large[kind] = _written(named if kind == "pairs" else named.withColumn("next_type", F.lit("")))
    return Boundaries(**held, tables=large, most=most)


def told(units: DataFrame, model: Boundaries, text: str = "text", by: Column | None = None) -> tuple[DataFrame, Boundaries]:
    """units with `_told`, what Boundaries.told() takes, and the model that it goes with, without tables.

    If the model has tables, units are read first for what they ask; if the answers are few, the model holds them and `_told`
    is null. Texts of a language that share a key share their entries, so that like keys of different ones do no harm.
    """
    plain = units.withColumn("_told", F.lit(None).cast("array<array<string>>"))
    if not model.tables:
        return plain, model
    sent = units.sparkSession.sparkContext.broadcast(model.held())
    small_batches(units.sparkSession)

    @F.pandas_udf("array<array<string>>")
    def asks(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, langs in batches:
            yield pd.Series([[list(a) for a in sent.value.asks(t, g)] for t, g in zip(texts, langs, strict=True)], dtype=object)

    keyed = {"_key": F.xxhash64(F.col(text)), "_lang": _lang(by)}
    entry = ["_lang", "kind", "type", "next_type"]
    asked = units.select(*[c.alias(k) for k, c in keyed.items()], F.explode(asks.asNondeterministic()(F.col(text), _lang(by))).alias("ask"))
    asked = _written(asked.select(*keyed, *[F.col("ask")[i].alias(c) for i, c in enumerate(entry[1:])]))
    known = None
    for kind, table in model.tables.items():
        one = table.select(F.col("lang").alias("_lang"), F.lit(kind).alias("kind"), "type", "next_type")
        known = one if known is None else known.unionByName(one)
    needed = _written(asked.select(*entry).distinct().join(known, entry))
    rows = needed.limit(model.most + 1).collect()
    if len(rows) <= model.most:
        own: dict[str, set] = {kind: set() for kind in model.tables}
        for lang, kind, *names in rows:
            own[kind].add((lang, *names[: 2 if kind == "pairs" else 1]))
        return plain, Boundaries(**{kind: own.get(kind, getattr(model, kind)) for kind in KINDS})
    # written, so that Spark may split what many copies of a text share
    found = _written(asked.join(needed, entry).groupBy(*keyed).agg(F.collect_set(F.array(*entry[1:])).alias("_told")))
    return units.withColumns(keyed).join(found, list(keyed), "left").drop(*keyed), model.held()


def sentences(units: DataFrame, model: Boundaries, text: str = "text", by: Column | None = None) -> DataFrame:
    """units with sentence_no and one sentence as text."""
    whole, model = told(units, model, text, by)
    sent = units.sparkSession.sparkContext.broadcast(model)
    small_batches(units.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, langs, known in batches:
            yield pd.Series([sent.value.told(k, g).split(t, g) for t, g, k in zip(texts, langs, known, strict=True)], dtype=object)

    own = [c for c in units.columns if c not in (text, "sentence_no")]
    return whole.withColumn("_cut", cut.asNondeterministic()(F.col(text), _lang(by), F.col("_told"))).select(*own, F.posexplode("_cut").alias("sentence_no", text))
