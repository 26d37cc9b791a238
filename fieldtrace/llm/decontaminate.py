"""Benchmark decontamination by templates.

Text becomes a template: numbers, names (capitalised words) and units turn into the placeholders 0, 1 and 2, other words
stay, lower-cased. An item also has a template without names, which copies in other case meet. Windows of ``window`` template tokens of the documents meet those of the benchmark items by hash. An item is in a
document when at least half of its windows are found there and the values behind the placeholders are
consistent along an alignment: wherever the item repeats a value the document repeats one too. All alignments are judged; the
consistent ones must hold half of the windows, or one of them as many as any alignment does. So a copied item is found, also
behind a text that merely has the same shape, and one with other numbers or names, but not that text.

Only DataFrame functions. The benchmark's windows are the small side; they are broadcast when their count is small, else the join is
shuffled. Hits are folded to one row per document, item and alignment in the map tasks first; aligning values needs the tokens
of documents that passed the first test only.

Defined cases: null or empty text has no windows; an item with fewer tokens than a window is one window of its own length, and one
without any token is never found; a window that holds less than half its length in words that are no placeholders (a dense one) meets only windows with its
own values, in any case, so an item of dense windows is found as a copy, and any item with half of all its windows too; repeated items are found
each; repeated rows get equal results; a null id is kept; empty tables give an empty result or no finds; extra columns are
passed on, and those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import join_small, let, query, row_key, stage
from fieldtrace.session import configure

WINDOW, NUM, DEN = 8, 1, 2
#: Units that become a placeholder.
UNITS = ("mm", "cm", "km", "kg", "mg", "ml", "mph", "kmh", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks",
         "week", "months", "month", "years", "year", "meters", "meter", "metres", "metre", "miles", "mile", "inches", "inch", "feet", "foot",
         "grams", "gram", "liters", "liter", "litres", "litre", "dollars", "dollar", "euros", "euro", "cents", "cent", "percent", "degrees")
_NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
_RAW = rf"({_NUMBER}|\p{{L}}+)"


def template(text: Column) -> Column:
    """The template tokens of a text, one for each of its ``values``."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _NUMBER, " 0 ")
    t = F.regexp_replace(t, r"(?<!\p{L})\p{Lu}\p{Ll}\p{L}*", "1")
    t = F.regexp_replace(F.lower(t), rf"(?<!\p{{L}})(?:{'|'.join(UNITS)})(?!\p{{L}})", "2")
    return F.filter(F.split(t, r"[^\p{L}012]+"), lambda w: w != "")


def values(text: Column) -> Column:
    """The tokens themselves, lower-cased: numbers and runs of letters."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_RAW), F.lit(1)), F.lower)


def _n_words(tokens: Column) -> Column:
    """How many template tokens are no placeholders."""
    for slot in ("0", "1", "2"):
        tokens = F.array_remove(tokens, slot)
    return F.size(tokens)


def _is_slot(token: Column) -> Column:
    return token.isin("0", "1", "2")


def _all_windows(tokens: Column, length: int) -> Column:
    """Where the windows of ``length`` tokens begin."""
    return F.when(F.size(tokens) >= length, F.sequence(F.lit(0), F.size(tokens) - length)).otherwise(F.array().cast("array<int>"))


def _dense_windows(tokens: Column, length: int) -> Column:
    """Where the dense windows begin: those around each run of so many placeholders, one after the other, as a dense window has at least."""
    least = length // 2 + 1

    def around(slots: Column) -> Column:
        def reach(k):
            first, last = F.get(slots, k), F.get(slots, k + (least - 1))
            begin, end = F.greatest(last - (length - 1), F.lit(0)), F.least(first, F.size(tokens) - length)
            return F.when((last - first < length) & (begin <= end), F.sequence(begin, end)).otherwise(F.array().cast("array<int>"))
        return F.when(F.size(slots) >= least, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size(slots) - least), reach)))).otherwise(
            F.array().cast("array<int>"))
    places = F.filter(F.transform(tokens, lambda w, i: F.when(_is_slot(w), i)), lambda i: i.isNotNull())
    return F.when(F.size(tokens) >= length, let(places, around)).otherwise(F.array().cast("array<int>"))


def _hashes(tokens: Column, length: int, at: Column, dense: bool = False) -> Column:
    """(hash, length, dense, at) of the windows of ``length`` tokens that begin at ``at``."""
    return F.transform(at, lambda i: F.struct(F.xxhash64(F.slice(tokens, i + 1, F.lit(length))).alias("hash"), F.lit(length).alias("length"),
                                              F.lit(dense).alias("dense"), i.alias("at")))


def _found(text: Column, lengths: list[tuple[int, bool]]) -> Column:
    """The windows of a text, of all the lengths: of templates, and of the own values of dense windows. Few texts have such, so the values are read when needed."""
    def windows(t: Column) -> Column:
        plain = [_hashes(t, n, _all_windows(t, n)) for n, dense in lengths if not dense]
        tight = [n for n, dense in lengths if dense]
        if not tight:
            return F.flatten(F.array(*plain))

        def of_values(at: Column) -> Column:
            none = F.array().cast("array<struct<hash: bigint, length: int, dense: boolean, at: int>>")
            own = let(values(text), lambda v: F.flatten(F.array(*[_hashes(v, n, F.get(at, i), True) for i, n in enumerate(tight)])))
            return F.when(F.exists(at, lambda a: F.size(a) > 0), own).otherwise(none)
        return F.flatten(F.array(*plain, let(F.array(*[_dense_windows(t, n) for n in tight]), of_values)))
    return let(template(text), windows)


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(hash, length, dense, item, item_at, n_windows, n_all) of the items' windows: templates, and the own values of dense ones."""
    tokens = benchmark.select(F.col(item_col).alias("item"), template(F.col(text_col)).alias("tokens"), values(F.col(text_col)).alias("own")).where(F.size("tokens") > 0)
    tokens = tokens.withColumn("length", F.least(F.size("tokens"), F.lit(window)))
    cut = tokens.select("item", "length", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("tokens") - F.col("length") + 1),
                                                                    lambda i: F.struct(F.slice("tokens", i, F.col("length")).alias("tokens"), F.slice("own", i, F.col("length")).alias("own"))))
                       .alias("item_at", "cut")).select("item", "length", "item_at", "cut.*")
    cut = cut.withColumn("dense", 2 * _n_words(F.col("tokens")) < F.col("length"))
    counted = cut.groupBy("item").agg(F.count_if(~F.col("dense")).alias("n_windows"), F.count(F.lit(1)).alias("n_all"))
    return cut.join(counted, "item").select(F.xxhash64(F.when(F.col("dense"), F.col("own")).otherwise(F.col("tokens"))).alias("hash"), "length", "dense", "item", "item_at", "n_windows", "n_all")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", window: int = WINDOW, num: int = NUM, den: int = DEN) -> DataFrame:
    """(rk, item): items found in the documents with that row key."""
    configure(docs.sparkSession)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.explode(F.array_distinct(F.array(F.col(item_text_col), F.lower(item_text_col)))).alias("text"))
    items = items.distinct().withColumn("item", row_key(F.col("item_id"), F.col("text")))
    known = stage(item_windows(items, "item", "text", window), "windows")
    lengths = sorted(tuple(r) for r in known.select("length", "dense").distinct().collect())  # at most twice ``window`` different ones
    keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("rk"), F.col(text_col).alias("text"))
    if not lengths:
        return keyed.select("rk", F.lit(None).cast("long").alias("item")).where("false")
    found = _found(F.col("text"), lengths)
    cut = keyed.select("rk", F.inline(found))
    hits = join_small(cut, known, ["hash", "length", "dense"], "inner")
    lines = (hits.groupBy("rk", "item", (F.col("at") - F.col("item_at")).alias("shift"))
             .agg(F.collect_set("item_at").alias("at"), F.collect_set(F.when(~F.col("dense"), F.col("item_at"))).alias("plain"),
                  F.first("n_windows").alias("n_windows"), F.first("n_all").alias("n_all"), F.first("length").alias("length")))
    n_of = lambda at: F.size(F.array_distinct(F.flatten(at)))

    def enough(found: Column) -> Column:
        plain, every = n_of(found["plain"]), n_of(found["at"])
        return ((F.col("n_windows") > 0) & (den * plain >= num * F.col("n_windows"))) | (den * every >= num * F.col("n_all"))
    pairs = stage(lines.groupBy("rk", "item").agg(F.first("n_windows").alias("n_windows"), F.first("n_all").alias("n_all"),
                                                   F.collect_list(F.struct("shift", "at", "plain", "length")).alias("lines")).where(enough(F.col("lines"))), "pairs")
    # the values behind the placeholders, along each alignment
    texts = join_small(keyed, stage(pairs.select("rk").distinct(), "found"), "rk", "left_semi").dropDuplicates(["rk"])
    doc_values = texts.select("rk", values(F.col("text")).alias("doc_values"))
    item_values = items.select("item", values(F.col("text")).alias("item_values"), template(F.col("text")).alias("tokens"))
    aligned = pairs.join(doc_values, "rk").join(item_values, "item")

    def consistent(line: Column) -> Column:  # dense windows have the item's own values
        places = F.array_distinct(F.flatten(F.transform(line["plain"], lambda a: F.sequence(a, a + line["length"] - 1))))
        slots = F.filter(places, lambda i: _is_slot(F.get("tokens", i)))
        bound = F.array_distinct(F.transform(slots, lambda i: F.struct(F.get("item_values", i).alias("item"), F.get("doc_values", i + line["shift"]).alias("doc"))))
        return let(bound, lambda b: F.size(b) == F.size(F.array_distinct(F.transform(b, lambda x: x["item"]))))

    longest = lambda found, part: F.array_max(F.transform(found[part], F.size))
    judged = aligned.select("item", "rk", "n_windows", "n_all", "lines", F.filter("lines", consistent).alias("good"))
    good, every = F.col("good"), F.col("lines")
    best = (F.col("n_windows") > 0) & (longest(good, "plain") > 0) & (longest(good, "plain") == longest(every, "plain"))
    judged = judged.where((F.size(good) > 0) & (enough(good) | best | (longest(good, "at") == longest(every, "at"))))
    return judged.join(items.select("item", F.col("item_id")), "item").select("rk", F.col("item_id").alias("item")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with contaminated and items (sorted ids of the items found)."""
    found = leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, window, num, den)
    by_doc = stage(found.groupBy(F.col("rk").alias("__rk")).agg(F.sort_array(F.collect_set("item")).alias("__items")), "leaks")
    keyed = docs.drop("contaminated", "items").withColumn("__rk", row_key(F.col(id_col), F.col(text_col)))
    out = join_small(keyed, by_doc, "__rk", "left")
    return out.withColumns({"contaminated": F.col("__items").isNotNull(),
                            "items": F.coalesce("__items", F.expr("array()").cast(by_doc.schema["__items"].dataType))}).drop("__rk", "__items")


@query("op3_decontaminate")
def op3_decontaminate(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate(docs, benchmark).select("doc_id", "contaminated", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"))
