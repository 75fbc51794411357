"""Keyword-stuffed and link-list pages, told from prose by the curve of their word frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import once
from graphloom.operators.skew import skew_join
from graphloom.session import cut, scratch_path

#: A word belongs to a language's prose if this share of its pages uses it. As a page uses a bounded
#: number of words on average, few words can: at most (mean number of words a page) / COMMON.
COMMON = 0.3
#: A language has a profile if it holds this share of the labelled pages and this many. At most
#: 1 / LANGUAGE_SHARE languages can.
LANGUAGE_SHARE = 1 / 1000
LANGUAGE_PAGES = 5
#: Shorter texts have no curve to speak of.
MIN_WORDS = 8
#: A band of lengths (a power of two of words) has its own reference from so many texts on.
BAND_TEXTS = 20
#: Limits of the decision: see ``spam_pages``.
LIMIT = 0.35
STEEP, ROUGH = 0.75, 0.5
FAR, JAGGED = 0.6, 0.5
RESIDUAL_SLACK = 0.1


def words(text: Column) -> Column:
    """The words of a text, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def page_texts(pages: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(``doc_id``, ``lang``, ``words``, ``key``) of pages that hold words, written once: the words in
    order, set apart by blanks, and their digest."""
    path = scratch_path(pages.sparkSession, "pages")
    told = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), once(F.array_join(words(F.col(text_col)), " ")).alias("words"))
    told.where(F.col("words") != "").withColumn("key", F.unhex(F.md5("words"))).write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def ranked_words(texts: DataFrame) -> DataFrame:
    """(``key``, ``lang``, ``word``, ``c``, ``r``): the words of each distinct text with their counts
    and ranks, written once; ``lang`` is the one most of its pages give.

    A text counts once however many pages repost it: copies combine on the map side, so one costs a
    row a task. One shuffle by text serves the counts and the ranks.
    """
    path = scratch_path(texts.sparkSession, "ranked")
    distinct = texts.groupBy("key").agg(F.mode("lang", True).alias("lang"), F.first("words").alias("words"))
    counts = distinct.select("key", "lang", F.explode(F.split("words", " ")).alias("word")).groupBy("key", "word").agg(F.first("lang").alias("lang"), F.count(F.lit(1)).alias("c"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("c")))  # which of equal words comes first changes no curve
    counts.select("key", "lang", "word", "c", rank.alias("r")).write.parquet(path)
    return texts.sparkSession.read.parquet(path)


def prose_words(ranked: DataFrame) -> DataFrame:
    """(``word``, ``langs``): the common words of each language, from all its distinct texts.

    Counts combine on the map side; what remains is bounded by COMMON and LANGUAGE_SHARE.
    """
    labelled = ranked.where(F.col("lang").isNotNull())
    sizes = labelled.where("r = 1").groupBy("lang").agg(F.count(F.lit(1)).alias("pages"))
    every = sizes.agg(F.sum("pages")).first()[0] or 0
    least = max(LANGUAGE_PAGES, every * LANGUAGE_SHARE)
    held = sizes.where(F.col("pages") >= least)
    used = labelled.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("df"))
    common = used.where(F.col("df") >= COMMON * least).join(F.broadcast(held), "lang").where(F.col("df") >= COMMON * F.col("pages"))
    return common.where(~F.col("word").rlike(r"^\d+$")).groupBy("word").agg(F.collect_list("lang").alias("langs"))


def rank_frequency_curves(ranked: DataFrame, profile: DataFrame) -> DataFrame:
    """Per distinct text: ``n`` words, ``slope`` and ``residual`` of log frequency over log rank, the
    ``share`` of prose words of any language (so that a passage in another one isn't strange) and the
    language ``best`` whose prose words are most frequent.

    ``profile`` is bounded (``prose_words``) and broadcast.
    """
    points = ranked.withColumn("x", F.ln("r")).withColumn("f", F.ln("c"))
    curve = points.groupBy("key").agg(
        F.min("lang").alias("lang"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"), F.regr_sxx("f", "x").alias("sxx"), F.regr_sxy("f", "x").alias("sxy"), F.regr_syy("f", "x").alias("syy")
    )
    slope = F.coalesce(F.try_divide(F.col("sxy"), F.col("sxx")), F.lit(0.0))
    residual = F.sqrt(F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0)) / F.col("k"))
    in_prose = ranked.join(F.broadcast(profile), "word").select("key", "c", F.explode(F.concat("langs", F.array(F.lit("")))).alias("l")).groupBy("key", "l").agg(F.sum("c").alias("s"))
    best = in_prose.groupBy("key").agg(F.max(F.when(F.col("l") == "", F.col("s"))).alias("s"), F.max_by("l", F.when(F.col("l") != "", F.struct("s", "l"))).alias("best"))
    joined = curve.join(best, "key", "left")
    return joined.select("key", "n", slope.alias("slope"), residual.alias("residual"), (F.coalesce("s", F.lit(0)) / F.col("n")).alias("share"), "best", "lang")


def relative_divergence(share: Column, usual: Column) -> Column:
    """How far a text's words diverge from prose of its language and length: the Kullback-Leibler
    divergence over the classes "prose word" and "other word", against that of a text without any
    prose word, from 0 to 1; 0 for a text with more prose words than usual, null without a reference."""
    p, q = share, F.greatest(F.lit(1e-6), F.least(usual, F.lit(1 - 1e-6)))
    part = lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0)
    return F.when(p >= usual, 0.0).when(usual > 0, (part(p, q) + part(1 - p, 1 - q)) / -F.ln(1 - q))


def spam_pages(pages: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(``doc_id``, ``score``, ``divergence``, ``steeper``, ``rougher``) of pages that aren't prose.

    Each text's words are ranked by frequency and a line is fitted to the logarithms. What a text of
    its language at a comparable length should show is taken over all distinct texts, so that
    reposting a page makes it no more usual: slope, residual and share of prose words as medians of
    its band of lengths (powers of two), or where a band holds under BAND_TEXTS texts as lines over
    the logarithm of the length and the language's median. ``divergence`` is ``relative_divergence``,
    ``steeper`` how much steeper the curve is, ``rougher`` how much more it strays from the line (less
    RESIDUAL_SLACK). ``score`` is divergence + STEEP * steeper + ROUGH * rougher, what is negative
    left out; above LIMIT the page is flagged, so each of the three can flag it alone. A divergence
    under FAR alone (another language, rare topics) is no reason: the curve must be steeper too, or
    rougher by JAGGED.

    The language is the given one, or where it is null or without a profile the one whose prose words
    are most frequent. A text without either, which holds not one prose word, has divergence 1 and is
    held against all texts; if there is no profile at all, its divergence is 0 and the curve alone
    decides. Texts of under MIN_WORDS words and null texts are never flagged; rows with a null id
    can't be named and are left out; a text repeated word for word counts once, and all its pages are
    flagged or none; an id with several texts is flagged for the worst; extra columns are ignored; an
    empty table gives no rows.
    """
    texts = page_texts(pages, id_col, text_col, lang_col)
    ranked = ranked_words(texts)
    profile = cut(prose_words(ranked))
    curves = cut(rank_frequency_curves(ranked, profile).where(F.col("n") >= MIN_WORDS))
    known = profile.select(F.explode("langs").alias("own")).distinct()
    placed = curves.join(F.broadcast(known), F.col("lang") == F.col("own"), "left").withColumn("l", F.coalesce("own", "best")).withColumn("x", F.ln("n")).withColumn("band", F.floor(F.log2("n")))
    usual = [F.percentile_approx(c, 0.5, 1000).alias(f"{c}0") for c in ("share", "slope", "residual")]
    line = [
        F.coalesce(F.regr_slope("slope", "x"), F.lit(0.0)).alias("sa"), F.coalesce(F.regr_intercept("slope", "x"), F.avg("slope")).alias("sb"),
        F.coalesce(F.regr_slope("residual", "x"), F.lit(0.0)).alias("ra"), F.coalesce(F.regr_intercept("residual", "x"), F.avg("residual")).alias("rb"), usual[0],
    ]
    of = lambda df: df.withColumn("of", F.lit(None).cast("string"))
    told = placed.where(F.col("l").isNotNull())
    by_language = told.groupBy(F.col("l").alias("of")).agg(*line).unionByName(of(placed.agg(*line))).withColumnRenamed("share0", "any0")
    bands = told.groupBy(F.col("l").alias("of"), "band").agg(F.count(F.lit(1)).alias("texts"), *usual).unionByName(of(placed.groupBy("band").agg(F.count(F.lit(1)).alias("texts"), *usual))).where(F.col("texts") >= BAND_TEXTS)
    held = placed.join(F.broadcast(by_language), F.col("l").eqNullSafe(F.col("of"))).drop("of")
    held = held.join(F.broadcast(bands.withColumnRenamed("band", "b")), F.col("l").eqNullSafe(F.col("of")) & (F.col("band") == F.col("b")), "left")
    share0 = F.coalesce("share0", "any0")
    # without a profile anywhere, a missing prose word says nothing
    divergence = F.when(F.col("l").isNull(), F.when(share0 > 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(relative_divergence(F.col("share"), share0), F.lit(0.0)))
    steeper = F.coalesce("slope0", F.col("sa") * F.col("x") + F.col("sb")) - F.col("slope")
    rougher = F.col("residual") - F.coalesce("residual0", F.col("ra") * F.col("x") + F.col("rb")) - RESIDUAL_SLACK
    scored = held.select("key", divergence.alias("divergence"), steeper.alias("steeper"), rougher.alias("rougher"))
    score = F.col("divergence") + STEEP * F.greatest("steeper", F.lit(0.0)) + ROUGH * F.greatest("rougher", F.lit(0.0))
    flagged = scored.withColumn("score", score).where((F.col("score") > LIMIT) & ((F.col("steeper") > 0) | (F.col("divergence") > FAR) | (F.col("rougher") > JAGGED)))
    found = skew_join(texts.select("doc_id", "key"), cut(flagged.select("key", "score", "divergence", "steeper", "rougher")), ["key"])
    worst = found.groupBy("doc_id").agg(F.max(F.struct("score", "divergence", "steeper", "rougher")).alias("worst"))
    return worst.select("doc_id", "worst.*")
