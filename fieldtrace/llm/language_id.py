"""Language ID by word-first backoff.

A text's words (lower-cased runs of letters) are scored one by one: a known word by its log frequency in each language;
an unseen one by its character n-grams, the longest length of which any n-gram is known, from 4 down to 1. Scores and the log share
of each language add up, and the posterior of the best language is the score.

All words of all training texts are counted, and the n-grams and totals come from all of these; words are summed per Arrow
batch before they are dealt out, so a word that makes up a third of all text is one row per batch and language. Each language's
most frequent words, ``most_words`` for all languages together, are broadcast with their scores and looked up where the text is
read. This only saves work: the other words of a text go, counted, through shuffled joins with the whole tables of words and n-grams.

Defined cases: a null text and one without letters are ``und`` with score 0; without any training text all are; a language
without any word is not learned; a null
lang and a null id are not learned from, and a null id is not held out; ties go to the first language by name; repeated rows
count as often as they occur and get equal results; an empty table gives an empty result; extra columns are passed
on, and those named like an output are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import join_small, query, row_key, stage
from fieldtrace.session import configure

MOST_WORDS, LONGEST, FOLDS, HELD_OUT = 100_000, 4, 5, 0
FLUSH = 400_000
#: Steps of frequency by which the broadcast words are chosen, for each factor e.
STEPS = 8
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its borders marked; single characters without the marks."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _count(batches):
    counts: dict[str, Counter] = {}

    def flush():
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                           pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, counts.values())) > FLUSH:
                yield flush()
    if counts:
        yield flush()


def _count_grams(batches):
    counts: dict[str, Counter] = {}

    def flush():
        rows = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                           pa.array([r[2] for r in rows], pa.int64())], names=["lang", "gram", "n"])

    for batch in batches:
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
            own = counts.setdefault(lang, Counter())
            for k in range(1, LONGEST + 1):
                for g in grams(word, k):
                    own[g] += n
        if sum(map(len, counts.values())) > FLUSH:
            yield flush()
    if counts:
        yield flush()


def _cut(batches, k: int):
    for batch in batches:
        rows = [(w, g) for w in batch.column("word").to_pylist() for g in grams(w, k)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["word", "gram"])


@dataclass
class Model:
    """The languages by name, the log of their shares, and the log frequencies in each of them: ``words`` (word, often, logs)
    and ``grams`` (gram, logs). The words that are often somewhere are broadcast."""
    langs: list[str]
    prior: np.ndarray
    words: DataFrame | None = None
    grams: DataFrame | None = None


def _logs(langs: list[str], divisors: list[float]) -> Column:
    """Smoothed log frequencies in each language from the map ``by_lang``."""
    table = F.array(*[F.struct(F.lit(lang).alias("lang"), F.lit(float(d)).alias("d")) for lang, d in zip(langs, divisors)])
    return F.transform(table, lambda x: F.log((F.coalesce(F.try_element_at("by_lang", x["lang"]), F.lit(0)) + 0.5) / x["d"]).cast("float"))


def _by_lang() -> Column:
    return F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS) -> Model:
    """The model of all rows with a language. ``most_words`` bounds the words that are broadcast, not those learned."""
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # sums per text table are few; words are many
    shares = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    counted = stage(known.mapInArrow(_count, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")), "counts")
    step = F.floor(F.log("n") * STEPS)
    steps = counted.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()
    totals = Counter()
    for r in steps:
        totals[r["lang"]] += r["n"]
    langs = sorted(lang for lang in shares if totals[lang])
    n = np.array([shares[lang] for lang in langs], float)
    model = Model(langs, np.log(n / n.sum()) if len(n) else n)
    if not langs:
        return model
    least = {}  # the step from which on a language's words are broadcast: as many whole steps as fit its part of the bound
    for lang in langs:
        room, least[lang] = most_words // len(langs), 1 << 30
        for r in sorted((r for r in steps if r["lang"] == lang), key=lambda r: -r["step"]):
            room -= r["words"]
            if room < 0:
                break
            least[lang] = r["step"]
    often = step >= F.try_element_at(F.create_map(*[F.lit(x) for item in least.items() for x in item]), F.col("lang"))
    words_ = stage(counted.groupBy("word").agg(F.max(often).alias("often"), _by_lang()), "words")
    n_words = words_.count()
    model.words = words_.select("word", "often", _logs(langs, [totals[x] + 0.5 * (n_words + 1) for x in langs]).alias("logs"))
    pieces = stage(counted.mapInArrow(_count_grams, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
                   .groupBy("gram").agg(_by_lang()).withColumn("k", F.length("gram")), "grams")
    own, sizes = Counter(), Counter()
    for r in pieces.select("k", F.explode("by_lang").alias("lang", "n")).groupBy("k", "lang").agg(F.sum("n").alias("n")).collect():
        own[r["k"], r["lang"]] = r["n"]
    for r in pieces.groupBy("k").count().collect():
        sizes[r["k"]] = r["count"]
    model.grams = pieces.select("k", "gram", F.coalesce(*[F.when(F.col("k") == k, _logs(langs, [own[k, x] + 0.5 * (sizes[k] + 1) for x in langs]))
                                                          for k in sorted(sizes)]).alias("logs"))
    return model


def _look_up(table: pa.Table, n_langs: int):
    """A function over batches (rk, text): the sums over the words of ``table`` and the other words, counted."""
    rows = {w: i for i, w in enumerate(table.column("word").to_pylist())}
    logs = np.array(table.column("logs").combine_chunks().flatten(), np.float32).reshape(len(rows), n_langs)
    return rows, logs


def _score(batches, shared, n_langs: int):
    rows, logs = shared.value
    for batch in batches:
        keys, sums, ends, rest, times = [], [], [0], [], []
        for rk, text in zip(batch.column("rk").to_pylist(), batch.column("text").to_pylist()):
            found = words(text)
            if not any(c.isalpha() for w in found for c in w):
                continue
            at = list(map(rows.get, found))
            keys.append(rk)
            sums.append(logs[[i for i in at if i is not None]].sum(axis=0, dtype=np.float64))
            other = Counter(w for w, i in zip(found, at) if i is None)
            rest.extend(other)
            times.extend(other.values())
            ends.append(len(rest))
        flat = pa.array(np.concatenate(sums) if sums else np.zeros(0))
        pairs = pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(times, pa.int64())], ["word", "times"])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, n_langs), pa.int32()), flat),
                                          pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=["rk", "sums", "rest"])


def _word_logs(needed: DataFrame, model: Model) -> DataFrame:
    """(word, logs) of distinct words: their own, else the mean over their known n-grams of the longest length that has any."""
    found = stage(needed.join(model.words.select("word", "logs"), "word", "left"), "known")
    out, left = found.where("logs is not null"), found.where("logs is null").select("word")
    for k in range(LONGEST, 0, -1):
        if left.isEmpty():
            break
        cut = left.mapInArrow(lambda batches, k=k: _cut(batches, k), "word string, gram string")
        mean = F.array(*[F.avg(F.get("logs", F.lit(i))) for i in range(len(model.langs))]).cast("array<float>").alias("logs")
        hit = stage(cut.join(model.grams.where(F.col("k") == k).select("gram", "logs"), "gram").groupBy("word").agg(mean), "unseen")
        out = out.unionByName(hit)
        left = stage(left.join(hit.select("word"), "word", "left_anti"), "left")
    return out


def language_id(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    spark, n = configure(docs.sparkSession), len(model.langs)
    if not n:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = spark.sparkContext.broadcast(_look_up(model.words.where("often").select("word", "logs").toArrow(), n))
    parts = stage(docs.select(row_key(F.col(text_col)).alias("rk"), F.col(text_col).alias("text"))
                  .mapInArrow(lambda batches: _score(batches, shared, n), "rk long, sums array<double>, rest array<struct<word string, times long>>")
                  .dropDuplicates(["rk"]), "parts")
    rest = parts.select("rk", F.inline("rest"))
    logs = _word_logs(rest.select("word").distinct(), model)
    more = rest.join(logs, "word").groupBy("rk").agg(F.array(*[F.sum(F.col("times") * F.get("logs", F.lit(i)).cast("double")) for i in range(n)]).alias("more"))
    prior = F.array(*[F.lit(float(p)) for p in model.prior])
    total = F.zip_with(F.zip_with(prior, "sums", lambda p, x: p + x), F.coalesce("more", F.array(*[F.lit(0.0)] * n)), lambda a, x: a + x)
    best = parts.select("rk", "sums").join(more, "rk", "left").select("rk", total.alias("all")).withColumn("most", F.array_max("all"))
    pred = stage(best.select(F.col("rk").alias("__rk"), F.get(F.array(*map(F.lit, model.langs)), F.array_position("all", F.col("most")).cast("int") - 1).alias("__lang"),
                             (1 / F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))).alias("__score")), "languages")
    keyed = docs.withColumn("__rk", row_key(F.col(text_col)))
    return join_small(keyed, pred, "__rk", "left").withColumns({
        "lang_pred": F.coalesce("__lang", F.lit("und")), "score": F.coalesce("__score", F.lit(0.0))}).drop("__rk", "__lang", "__score")


@query("op2_language_id")
def op2_language_id(spark, folder):
    configure(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    model = train(docs.where(~held_out))
    return language_id(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
