"""Token budgets: estimates, compression levels and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import paths, text as T

#: Planning factors of the compression levels, dollars per million tokens by model.
FACTOR = {0: 1.0, 1: 0.70, 2: 0.25}
PRICE_PER_MILLION = {"sonnet": 3.0, "opus": 15.0, "haiku": 0.8}
DEFAULT_BUDGET, RULE_BUDGET, TOKENS_PER_SYMBOL = 8000, 1000, 50


def base_tokens(char_count: Column, symbols: Column) -> Column:
    """A quarter of the bytes; where that is 0 or unknown 50 per symbol."""
    quarter = F.floor(F.coalesce(char_count, F.lit(0)) / 4)
    return F.when(quarter > 0, quarter).otherwise(F.coalesce(symbols, F.lit(0)) * TOKENS_PER_SYMBOL).cast("long")


def estimate(base: Column, level: Column | int) -> Column:
    """Base, floor(.70 base), floor(.25 base) for levels 0, 1, 2."""
    lv = F.lit(level) if isinstance(level, int) else level
    return F.when(lv == 1, F.floor(base * FACTOR[1])).when(lv == 2, F.floor(base * FACTOR[2])).otherwise(base).cast("long")


def choose_level(items: DataFrame, budget: int) -> DataFrame:
    """B1: one row ``(level, adjusted, exceeded)``: the lowest level at which all of ``items(base)`` fit, else 2 and exceeded."""
    sums = items.agg(*[F.coalesce(F.sum(estimate(F.col("base"), lv)), F.lit(0)).alias(f"s{lv}") for lv in FACTOR])
    level = F.when(F.col("s0") <= budget, 0).when(F.col("s1") <= budget, 1).otherwise(2)
    return sums.select(level.alias("level"), (level > 0).alias("adjusted"), (F.col("s2") > budget).alias("exceeded"))


def rule_level(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``(path, level)``: the level that the rules ``(pattern, level)`` give a path, null without a match.

    Exact path, then exact file name, then the star pattern with the longest fixed part, then alphabetically.  Exact rules
    are equi-joins; only the star patterns, a configuration of at most 1,000 rows, are matched one by one.
    """
    stars = [(r.pattern, r.level) for r in rules.where(F.col("pattern").contains("*")).limit(1001).collect()]
    if len(stars) > 1000:
        raise ValueError("at most 1,000 star patterns")
    stars.sort(key=lambda r: (-len(r[0].replace("*", "").encode()), r[0]))
    name = paths.file_name(F.col("path"))
    glob = F.lit(None).cast("int")
    for pattern, level in reversed(stars):
        glob = F.when(T.glob_match(name, F.lit(pattern)), F.lit(level)).otherwise(glob)
    exact = rules.groupBy("pattern").agg(F.min("level").alias("l"))
    f = files.select("path", name.alias("_n"), glob.alias("_g"))
    f = f.join(exact.select(F.col("pattern").alias("path"), F.col("l").alias("_p")), "path", "left").join(exact.select(F.col("pattern").alias("_n"), F.col("l").alias("_f")), "_n", "left")
    return f.select("path", F.coalesce("_p", "_f", "_g").cast("int").alias("level"))


def compressed_files(files: DataFrame, level: int = 1) -> DataFrame:
    """``(file_id, content, original, compressed, rate)`` of ``files(file_id, language, text)``: sizes in bytes, the saved share in percent.

    Level 0 saves nothing; another level than 0, 1 and 2 counts as 0.  Null texts give nulls and ``0%``.
    """
    out = T.compress(F.col("text"), F.col("language"), F.lit(level))
    sized = files.select("file_id", out.alias("content"), F.octet_length("text").alias("original")).withColumn("compressed", F.octet_length("content"))
    share = F.bround(F.greatest((1 - F.col("compressed") / F.greatest("original", F.lit(1))) * 100, F.lit(0.0)), 0).cast("int")
    rate = F.lit("0%") if level not in (1, 2) else F.concat(F.when(F.col("original") > 0, share).otherwise(0).cast("string"), F.lit("%"))
    return sized.withColumn("rate", F.coalesce(rate, F.lit("0%")))


def savings(full: Column, sent: Column) -> Column:
    """The saved share as ``%.0f%%`` of a float, halves to even; ``0%`` of nothing."""
    share = ((full - sent).cast("double") * 100 / F.when(full > 0, full)).cast("float")
    return F.coalesce(F.concat(F.bround(share.cast("double"), 0).cast("long").cast("string"), F.lit("%")), F.lit("0%"))


def cost(tokens: Column, model: str) -> Column:
    """Dollars with two decimals, halves up; an unknown model costs what sonnet does.  Counted in exact decimals."""
    per = next((p for m, p in PRICE_PER_MILLION.items() if m in model.lower()), PRICE_PER_MILLION["sonnet"])
    cents = F.round(tokens.cast("decimal(20,0)") * F.lit(str(per)).cast("decimal(6,2)") / F.lit(10_000).cast("decimal(6,0)"), 0).cast("long")
    return F.format_string("$%d.%02d", F.floor(cents / 100), cents % 100)


def totals(packed: DataFrame, workspace_tokens: Column) -> DataFrame:
    """``(sent, saved)`` of ``packed(tokens)``; saved is never below 0."""
    return packed.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("sent")).select("sent", F.greatest(workspace_tokens - F.col("sent"), F.lit(0)).alias("saved"))
