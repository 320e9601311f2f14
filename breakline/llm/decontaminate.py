"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts become template tokens: numbers, units after a number and capitalised words, wherever they stand, turn into typed
placeholders, everything else into lower-case words without punctuation. Windows of ``WINDOW`` template tokens of the
documents are hash-joined with those of the benchmark items, and so are windows of plain lower-case tokens, which find copies whose
case or line breaks differ. A match gives an alignment (document, item, offset); within an
alignment each slot value of the item must always meet one and the same value in the document, else the template windows that cover
it are dropped, though never those that match in plain tokens. So a re-parameterised question (other numbers, other names, used alike) is caught and a jumble of numbers isn't.
A document is contaminated by an item if its windows that match in either way are ``MIN_COVERAGE`` of the item's, or
if ``MIN_RUN`` of them have one offset. An item under ``WINDOW`` tokens is one window of all its plain tokens. Windows of placeholders alone
count as plain ones only, and of a run of one token in an item its first window alone counts; so a page of numbers doesn't
meet an item of numbers in all pairs of places.

The item windows are broadcast only if they are counted to be few, else the join shuffles. The documents' windows are never grouped:
only matches are. Texts are read a second time for documents with matches alone, and only if an item has slots.

Defined results: null texts and items without tokens match nothing; short documents match short items alone; an empty table or an empty
benchmark gives an empty report and keeps every document; rows equal in id and text are judged alike; null ids are kept
apart by their text; other columns are ignored by the report and kept by ``decontaminate``, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Apart, materialise, small_or_not

WINDOW = 5
MIN_COVERAGE = 0.8
MIN_RUN = 13

# Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces "
    "ml l litre litres liter liters gallon gallons "
    "ms s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent "
    "hz khz mhz ghz w kw mw v a j kj n pa kpa kmh mph"
).split()

# Placeholders are tokens of their own, in lower case so that none is taken for a name.
NUMBER, NAME, UNIT = "xnumber", "xname", "xunit"


def marked(df: DataFrame, *keys: Column | str) -> DataFrame:
    """(keys, text) to (keys, digits, sep): whether there are digits, and the text with each number one token: decimal marks inside turn to _, and a unit that sticks to it is parted."""
    found = df.select(*keys, F.col("text").rlike(r"\p{Nd}").alias("digits"), "text")
    joined = F.regexp_replace("text", r"[.,](?<=\p{Nd}[.,])(?=\p{Nd})", "_")
    parted = F.regexp_replace(joined, r"(\p{Nd}(?<![\p{L}\p{N}_]\p{Nd})[\p{Nd}_]*)(?=\p{L})", "$1 ")
    return found.select(*keys, "digits", F.when(F.col("digits"), parted).otherwise(F.col("text")).alias("sep"))


def split_tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[^\p{L}\p{M}\p{N}_]+"), "")


def template_text() -> Column:
    """Of a marked text: with placeholders; it has the same number of tokens."""
    number = F.regexp_replace("sep", r"\p{Nd}(?<![\p{L}\p{N}_]\p{Nd})[\p{Nd}_]*(?![\p{L}\p{N}_])", NUMBER)
    unit = F.regexp_replace(number, rf"(\b{NUMBER}[\s\p{{Z}}]+)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}_])", f"$1{UNIT}")
    numbered = F.when(F.col("digits"), unit).otherwise(F.col("sep"))
    return F.lower(F.regexp_replace(numbered, r"\p{Lu}(?<![\p{L}\p{M}\p{N}_]\p{Lu})[\p{L}\p{M}]*\p{Ll}[\p{L}\p{M}]*(?![\p{N}_])", NAME))


def tokens(df: DataFrame) -> DataFrame:
    """(key, digits, sep) to (key, t, p): template tokens and plain ones, as many of either."""
    return df.select("key", split_tokens(template_text()).alias("t"), split_tokens(F.lower("sep")).alias("p"))


def _windows(df: DataFrame, size: int, *columns: str) -> tuple[DataFrame, list[Column]]:
    """(key, t, p, pos) of each place where ``size`` tokens begin, and the hashes of that many tokens of ``columns``.

    One row a place, in compiled code that indexes the token arrays; the arrays go no further than the next projection.
    """
    each = df.where(F.size("p") >= size).select("key", "t", "p", F.explode(F.sequence(F.lit(0), F.size("p") - size)).alias("pos"))
    return each, [F.xxhash64(*[F.get(F.col(c), F.col("pos") + k) for k in range(size)]) for c in columns]


def _one_or_two(places: DataFrame) -> DataFrame:
    """(key, pos, wt, wp) to (key, pos, w, plain): the window of plain tokens and, where it differs, that of template tokens."""
    one = lambda w, plain: F.struct(F.col(w).alias("w"), F.lit(plain).alias("plain"))
    both = F.when(F.col("wt") == F.col("wp"), F.array(one("wp", True))).otherwise(F.array(one("wp", True), one("wt", False)))
    return places.select("key", "pos", F.explode(both).alias("x")).select("key", "pos", "x.w", "x.plain")


def _hashes(df: DataFrame, window: int, sizes: list[int]) -> DataFrame:
    """(key, t, p) of documents to (key, pos, w, plain): hashes of all windows, and of all plain windows of the shorter ``sizes``."""
    each, (wt, wp) = _windows(df, window, "t", "p")
    out = _one_or_two(each.select("key", "pos", wt.alias("wt"), wp.alias("wp")))
    for size in sizes:
        each, (w,) = _windows(df, size, "p")
        out = out.unionByName(each.select("key", "pos", w.alias("w"), F.lit(True).alias("plain")))
    return out


def _item_hashes(df: DataFrame, window: int) -> DataFrame:
    """(key, t, p) of items to (key, pos, w, plain), with the shorter items as one window each.

    Template windows of placeholders alone are left out, and windows within a run of one token but for the run's first: neither tells anything, and
    a page of numbers would meet them in all pairs of places.
    """
    each, (wt, wp) = _windows(df, window, "t", "p")
    token = lambda c, k: F.get(F.col(c), F.col("pos") + k)
    every = lambda conditions: functools.reduce(lambda a, b: a & b, conditions)
    within = (F.col("pos") > 0) & every(token("p", k) == token("p", k - 1) for k in range(window))
    blank = every(token("t", k).isin(NUMBER, NAME, UNIT) for k in range(window))
    out = _one_or_two(each.where(~F.coalesce(within, F.lit(False))).select("key", "pos", F.when(blank, wp).otherwise(wt).alias("wt"), wp.alias("wp")))
    for size in range(1, window):
        each, (w,) = _windows(df.where(F.size("p") == size), size, "p")
        out = out.unionByName(each.select("key", "pos", w.alias("w"), F.lit(True).alias("plain")))
    return out


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).alias("key"), text.alias("text"))


def _slots(df: DataFrame) -> DataFrame:
    """(key, digits, sep) to (key, pos, kind, value) of its placeholders."""
    each = tokens(df).select("key", F.posexplode(F.arrays_zip("t", "p")).alias("pos", "x"))
    return each.where(F.col("x.t").isin(NUMBER, NAME, UNIT)).select("key", "pos", F.col("x.t").alias("kind"), F.col("x.p").alias("value"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, min_coverage: float = MIN_COVERAGE, min_run: int = MIN_RUN) -> DataFrame:
    """(key, item_id, n_windows, n_matched, longest, coverage) per contaminated document key and item."""
    items = benchmark.select(F.col(item_col).cast("long").alias("key"), F.col(item_text).cast("string").alias("text")).where(F.col("key").isNotNull()).distinct()
    items = marked(items, "key")
    grid = materialise(_item_hashes(tokens(items), window).withColumnsRenamed({"key": "item_id", "pos": "ipos"}), "item-windows")
    n_grid = grid.count()
    n_tokens = tokens(items).select(F.size("p").alias("n")).where(F.col("n").between(1, window - 1)).distinct()
    sizes = sorted(r["n"] for r in n_tokens.collect())  # below the window's
    keyed = marked(_keyed(docs, id_col, text_col), "key")
    own = _hashes(tokens(keyed), window, sizes).select("key", "pos", "w")
    hits = materialise(own.join(small_or_not(grid, n_grid), "w").select("key", "item_id", F.col("pos") - F.col("ipos"), "ipos", "plain").toDF("key", "item_id", "offset", "ipos", "plain").distinct(), "hits")
    slots = materialise(_slots(items).withColumnsRenamed({"key": "item_id", "pos": "spos"}), "item-slots")
    n_slots = slots.count()
    runs = hits.where("plain").drop("plain")
    if n_slots:
        # a window whose plain tokens match as well needs no look at its slots
        like = hits.where(~F.col("plain")).drop("plain")
        met = like.join(small_or_not(slots, n_slots), "item_id").where((F.col("spos") - F.col("ipos")).between(0, window - 1))
        met = met.select("key", "item_id", "offset", "kind", "value", (F.col("offset") + F.col("spos")).alias("pos")).withColumnRenamed("value", "ivalue").distinct()
        wanted = met.select("key").distinct()
        n_wanted = wanted.count()
        said = _slots(keyed.join(small_or_not(wanted, n_wanted), "key", "left_semi")).distinct()
        told = met.join(said, ["key", "pos", "kind"]).groupBy("key", "item_id", "offset", "kind", "ivalue").agg(F.count_distinct("value").alias("n"))
        bad = told.where(F.col("n") > 1).join(small_or_not(slots.withColumnRenamed("value", "ivalue"), n_slots), ["item_id", "kind", "ivalue"])
        bad = bad.select("key", "item_id", "offset", F.explode(F.sequence(F.col("spos") - (window - 1), F.col("spos"))).alias("ipos")).distinct()
        runs = runs.unionByName(like.join(bad, ["key", "item_id", "offset", "ipos"], "left_anti")).distinct()
    size = grid.groupBy("item_id").agg(F.count_distinct("ipos").alias("n_windows"))
    by_run = runs.groupBy("key", "item_id", "offset").agg(F.count(F.lit(1)).alias("n"))
    longest = by_run.groupBy("key", "item_id").agg(F.max("n").alias("longest"))
    found = runs.select("key", "item_id", "ipos").distinct().groupBy("key", "item_id").agg(F.count(F.lit(1)).alias("n_matched"))
    found = found.join(longest, ["key", "item_id"]).join(small_or_not(size, n_grid), "item_id")
    found = found.withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    return found.where((F.col("coverage") >= min_coverage) | (F.col("longest") >= min_run)).select("key", "item_id", "n_windows", "n_matched", "longest", "coverage")


def leak_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, n_windows, n_matched, longest, coverage."""
    slim = docs.select("doc_id", "text")
    found = materialise(contaminated(slim, benchmark, **options), "contaminated")
    n = found.count()
    return _keyed(slim, "doc_id", "text").select(F.col("id").alias("doc_id"), "key").join(small_or_not(found, n), "key").drop("key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated documents."""
    own = Apart(docs)
    slim = own.df.select(own.col(id_col).alias("doc_id"), own.col(text_col).alias("text"))
    found = materialise(contaminated(slim, benchmark, **options).select("key").distinct(), "contaminated")
    keyed = own.df.withColumn("key", F.xxhash64(F.coalesce(own.col(id_col).cast("string"), F.lit("")), own.col(text_col).cast("string")))
    return own.back(keyed.join(small_or_not(found, found.count()), "key", "left_anti"))
