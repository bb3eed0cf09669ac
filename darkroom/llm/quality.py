"""Quality rules over step details with thresholds learned per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from darkroom.session import cut_lineage

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
GROUP = ["language", "origin"]


def text_counts(
    steps: DataFrame, id: str = "id", detail: str = "detail", language: str = "lang", origin: str = "source"
) -> DataFrame:
    """``id, language, origin, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``."""
    rows = steps.select(
        F.col(id).alias("id"), F.col(language).alias("language"), F.col(origin).alias("origin"),
        F.coalesce(F.col(detail).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.select(
        "*",
        F.filter(F.split("text", SPACES), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("lines"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "id", *GROUP, "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.slice(
            F.transform("words", lambda w, i: F.struct(
                F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("p")
            )), F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)),
        ).alias("grams"),
    )
    rows = rows.select("*", F.sort_array("grams").alias("ordered")).drop("grams")
    near = lambda g, i: g["h"] == F.get("ordered", i)["h"]
    rows = rows.select("*", F.sort_array(F.transform(
        F.filter("ordered", lambda g, i: F.coalesce(near(g, i - 1), F.lit(False)) | F.coalesce(near(g, i + 1), F.lit(False))),
        lambda g: g["p"],
    )).alias("hits")).drop("ordered")
    covered = F.transform("hits", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("hits", i + 1) - p, F.lit(3))))
    return rows.select(
        "id", *GROUP, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
    )


def _ratios() -> dict[str, Column]:
    per_mille = lambda a, b: F.expr(f"case when {b} > 0 then (1000 * {a}) div {b} end")
    return {
        "word_size": per_mille("word_chars", "n_words"), "symbols": per_mille("n_symbols", "word_chars"),
        "dup_lines": per_mille("n_dup_lines", "n_lines"), "repeats": per_mille("n_repeat_words", "n_words"),
    }


def quantile_sketch(counts: DataFrame, by: list[str]) -> DataFrame:
    """``by, ratio, bucket, n``: how many rows have a ratio in a bucket.

    A bucket keeps the ten leading bits of a value, so a quantile is off by less than 0.2 percent.
    Sketches of parts merge by adding ``n``, in any order, with the same result.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("ratio"), v.alias("v")) for k, v in _ratios().items()])
    long = counts.where("n_words > 0").select(*by, F.explode(pairs).alias("p")).where("p.v is not null")
    bucket = F.expr("shiftleft(shiftright(p.v, greatest(length(bin(p.v)) - 10, 0)), greatest(length(bin(p.v)) - 10, 0))")
    return long.groupBy(*by, F.col("p.ratio").alias("ratio"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, by: list[str], reach: int = 4) -> DataFrame:
    """``by, ratio, total, low, high``: the quartiles widened by ``reach`` times their distance.

    Where the quartiles are equal the outer eighths are widened, each by ``reach`` times its own
    distance from them. Where the eighths are equal too, every value beyond them is outside.
    """
    key = W.partitionBy(*by, "ratio")
    ranked = sketch.withColumn("upto", F.sum("n").over(key.orderBy("bucket"))).withColumn("total", F.sum("n").over(key))
    at = lambda share: F.min(F.when(F.col("upto") * 8 >= F.col("total") * share, F.col("bucket")))
    parts = ranked.groupBy(*by, "ratio").agg(F.max("total").alias("total"), *[at(k).alias(f"e{k}") for k in (1, 2, 6, 7)])
    apart = F.col("e6") - F.col("e2")
    low = F.when(apart > 0, F.col("e2") - apart * reach).otherwise(F.col("e1") - (F.col("e2") - F.col("e1")) * reach)
    high = F.when(apart > 0, F.col("e6") + apart * reach).otherwise(F.col("e7") + (F.col("e7") - F.col("e6")) * reach)
    return parts.select(*by, "ratio", "total", low.alias("low"), high.alias("high"))


def judge_quality(
    steps: DataFrame, id: str = "id", detail: str = "detail", language: str = "lang", origin: str = "source",
    least_rows: int = 50,
) -> DataFrame:
    """Counts of every step's detail and whether it is kept.

    A row fails outright below 50 words or when more than half of its words lie in repeated
    three-word windows. Otherwise its mean word length, symbol share, repeated lines and repeated
    words are held against fences around the quartiles (or eighths, see ``fences``) of its own
    language and source, with no fixed cutoffs. A
    language-and-source pair of fewer than ``least_rows`` rows uses the merged sketch of its
    language; a language of fewer rows has no fence.

    Returns ``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``
    per row. Nulls: a null detail is empty; null languages and sources are groups of their own.
    Repeated rows are judged each on its own. An empty table gives no rows.
    """
    counts = cut_lineage(text_counts(steps, id, detail, language, origin))
    fine = cut_lineage(quantile_sketch(counts, GROUP))
    coarse = fine.groupBy("language", "ratio", "bucket").agg(F.sum("n").alias("n"))
    wide = lambda f, by: f.where(F.col("total") >= least_rows).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("ratio", F.struct("low", "high")))).alias("fence")
    )
    own = wide(fences(fine, GROUP), GROUP).select(F.col("language").alias("l1"), F.col("origin").alias("o1"), F.col("fence").alias("own"))
    shared = wide(fences(coarse, ["language"]), ["language"]).select(F.col("language").alias("l2"), F.col("fence").alias("shared"))
    groups = fine.select(*GROUP).distinct()
    chosen = groups.join(own, F.col("language").eqNullSafe(F.col("l1")) & F.col("origin").eqNullSafe(F.col("o1")), "left").join(
        shared, F.col("language").eqNullSafe(F.col("l2")), "left"
    ).select(F.col("language").alias("gl"), F.col("origin").alias("go"), "own", "shared")
    judged = counts.join(chosen, F.col("language").eqNullSafe(F.col("gl")) & F.col("origin").eqNullSafe(F.col("go")), "left")
    outside = F.lit(False)
    for name, value in _ratios().items():
        fence = F.coalesce(F.try_element_at("own", F.lit(name)), F.try_element_at("shared", F.lit(name)))
        far = value > fence["high"]
        outside = outside | F.coalesce((far | (value < fence["low"])) if name == "word_size" else far, F.lit(False))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~outside).alias("kept"),
    )
