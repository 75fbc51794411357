"""Visually identical text: one consistent form, by folding and script-aware repair."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.skew import skew_join
from graphloom.session import cut, scratch_path

# Letters that look like a Latin letter, by script.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝӏАВЕКМНОРСТУХІЈЅԌԚԜ", "aeopcyxijshdqwlABEKMHOPCTYXIJSGQW", strict=True))
GREEK = dict(zip("οναιρυκγΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovaipukyABEZHIKMNOPTYX", strict=True))
LATIN_VARIANTS = dict(zip("ɡɑıꞬ", "gaiG", strict=True))
#: Separates the parts of a text (title lines, given and family names) inside one string.
SEPARATOR = "\x1e"
MISSING = "\x1f"
#: Parts of the records of one text that meet those of another.
SALT = 8

TO_LATIN = CYRILLIC | GREEK | LATIN_VARIANTS
TO_SCRIPT = {
    "L": TO_LATIN,
    "C": {latin: c for c, latin in reversed(CYRILLIC.items())} | {g: c for g, latin in GREEK.items() for c, l2 in CYRILLIC.items() if l2 == latin},
    "G": {latin: g for g, latin in reversed(GREEK.items())} | {c: g for c, latin in CYRILLIC.items() for g, l2 in GREEK.items() if l2 == latin},
}
_AMBIGUOUS = frozenset(TO_LATIN) | frozenset(CYRILLIC.values()) | frozenset(GREEK.values())
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_LIGATURES = {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)}
_FULL_WIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵ㅤ︀-️]+")
_BLANK = regex.compile(r"[\p{Z}\t\n\r\f\v\u0085]+")
_OUTER = regex.compile(rf" *({SEPARATOR}) *")


def fold(text: str) -> str:
    """Text without what no reader sees: width, ligatures, kinds of blanks, invisible characters and
    the order in which accents are written."""
    if not text.isascii():  # ASCII has no width, ligatures, invisible characters or accents
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text.translate(_FULL_WIDTH | _LIGATURES)))
    return _OUTER.sub(r"\1", _BLANK.sub(" ", text)).strip(" ")


def script(ch: str) -> str:
    """L, C, G for Latin, Cyrillic, Greek; V for a Latin variant; '' for marks and other letters."""
    if ch in LATIN_VARIANTS:
        return "V"
    code = ord(ch)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "L" if ch.isalpha() else ""
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "G"
    return "C" if 0x400 <= code < 0x530 else ""


def _counts(word: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for ch in word:
        if s := script(ch):
            out[s] = out.get(s, 0) + 1
    return out


def _substitute(word: str, target: str) -> str | None:
    """``word`` with every letter of another script replaced by its look-alike, if each has one."""
    table, out = TO_SCRIPT[target], []
    for ch in unicodedata.normalize("NFD", word):
        if (s := script(ch)) in ("", target):
            out.append(ch)
        elif ch in table:
            out.append(table[ch])
        else:
            return None
    return unicodedata.normalize("NFC", "".join(out))


def repairs(folded: str, whole: bool = True) -> tuple[list[tuple[int, str, int, str, bool]], set[str]]:
    """(place, word, rank, candidate, in the text's script) for every word whose scripts are mixed, dominant script first;
    and the words, in lower case, that are wholly in the script of the text.

    A word that is wholly of another script than the text, and could be read in the text's script
    letter by letter, is a candidate too if ``whole``. Letters that only one script has decide which script a
    text is in; letters with look-alikes count only where there are no others.
    """
    if folded.isascii():
        return [], {w.lower() for w in _WORD.findall(folded)}
    words = [(m.start(), m.group()) for m in _WORD.finditer(folded)]
    counted = [_counts(w) for _, w in words]
    letters = [ch for _, w in words for ch in w]
    plain = {s: sum(script(ch) == s and ch not in _AMBIGUOUS for ch in letters) for s in "LCG"}
    every = {s: sum(script(ch) == s for ch in letters) for s in "LCG"}
    main = max("LCG", key=lambda s: (plain[s], every[s]))
    pure = {w.lower() for (_, w), c in zip(words, counted, strict=True) if set(c) == {main}}
    out = []
    for (at, word), c in zip(words, counted, strict=True):
        if len(c) > 1 or "V" in c:
            targets = sorted("LCG", key=lambda s: (-c.get(s, 0), s != main))
        elif whole and c and main not in c:
            targets = [main]
        else:
            continue
        found = [(x, t == main) for t in targets if (x := _substitute(word, t)) is not None and x != word]
        out += [(at, word, rank, x, home) for rank, (x, home) in enumerate(found)]
    return out, pure


_FIXES = "array<struct<at:int,word:string,rank:int,candidate:string,home:boolean>>"


def _folder(whole: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            folded = [fold(t) for t in batch["raw"]]
            found = [repairs(t, whole) for t in folded]
            fixes = [[dict(zip(("at", "word", "rank", "candidate", "home"), r, strict=True)) for r in own] for own, _ in found]
            yield batch.assign(folded=folded, fixes=fixes, words=[sorted(pure) for _, pure in found])

    return run


@F.pandas_udf(T.StringType())
def _apply(folded: pd.Series, fixes: pd.Series) -> pd.Series:
    out = []
    for text, own in zip(folded, fixes, strict=True):
        for fix in sorted(own, key=lambda f: -f["at"]):
            text = text[: fix["at"]] + fix["candidate"] + text[fix["at"] + len(fix["word"]) :]
        out.append(unicodedata.normalize("NFC", text))
    return pd.Series(out)


def consistent_forms(texts: DataFrame, known_only: bool = False) -> DataFrame:
    """(``id``, ``field``, ``raw``, ``form``) of every distinct (``id``, ``field``, ``raw``) of ``texts``.

    ``raw`` may hold parts, joined by SEPARATOR; null texts give no row, empty ones an empty form;
    extra columns are ignored; an empty table gives no rows. Folding alone settles pure words. In a
    word of mixed scripts (dominant script first) look-alike letters are substituted only where the
    result occurs somewhere in ``texts``: in the script of its text, or as the common reading of
    several broken spellings; other words stay as they are. ``known_only`` is the method alone: words
    of mixed scripts only, and results that occur unbroken.
    """
    spark = texts.sparkSession
    path = scratch_path(spark, "folded")
    rows = texts.where(F.col("raw").isNotNull()).select(F.col("id").cast("bigint").alias("id"), F.col("field").cast("string").alias("field"), F.col("raw").cast("string").alias("raw"))
    rows.mapInPandas(_folder(not known_only), f"id bigint, field string, raw string, folded string, fixes {_FIXES}, words array<string>").write.parquet(path)
    table = spark.read.parquet(path)
    plain = table.where(F.size("fixes") == 0).select("id", "field", "raw", F.col("folded").alias("form")).distinct()
    broken = table.where(F.size("fixes") > 0).dropDuplicates(["id", "field", "raw"])

    broken_words = broken.select(F.explode("fixes").alias("fix")).select(F.lower("fix.word").alias("broken"), F.lower("fix.candidate").alias("word"), "fix.home")
    wanted = broken_words.select("word").distinct()
    known = wanted.join(table.select(F.explode("words").alias("word")).distinct(), "word", "left_semi")
    # a word that never occurs unbroken, but which several broken spellings lead to, exists too
    shared = broken_words.where("home").groupBy("word").agg(F.countDistinct("broken").alias("n")).where("n > 1").select("word")
    known = known if known_only else known.unionByName(shared).distinct()

    each = broken.select("id", "field", "raw", F.explode("fixes").alias("fix")).withColumn("word", F.lower("fix.candidate")).join(known, "word", "left_semi")
    best = each.groupBy("id", "field", "raw", "fix.at").agg(F.min_by("fix", "fix.rank").alias("fix"))
    accepted = best.groupBy("id", "field", "raw").agg(F.collect_list("fix").alias("accepted"))
    repaired = broken.join(accepted, ["id", "field", "raw"], "left").select("id", "field", "raw", _apply("folded", F.coalesce("accepted", F.array().cast(_FIXES))).alias("form"))
    return plain.unionByName(repaired)


def joined(parts: Column) -> Column:
    """An array of texts as one string with separators; nulls stay apart from empty texts."""
    return F.array_join(parts, SEPARATOR, MISSING)


def look_alike_classes(forms: DataFrame) -> DataFrame:
    """(``field``, ``record``, ``class``, ``texts``, ``records``): records whose form is shared by texts
    of other characters, with the digest of that form and how many texts and rows show it.

    One row a record and text, so a class of any size stays linear. Blank forms are no case.
    """
    shown = forms.where(F.translate("form", f" {SEPARATOR}{MISSING}", "") != "").select("field", F.col("id").alias("record"), F.sha2("form", 256).alias("class"), F.unhex(F.md5("raw")).alias("text"))
    shown = cut(shown)
    texts = shown.groupBy("field", "class", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("field", "class").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("records")).where("texts > 1")
    return skew_join(shown, texts, ["field", "class"])


def visually_equal(forms: DataFrame) -> DataFrame:
    """(``field``, ``record_a``, ``record_b``): records with the same form but other characters.

    ``record_a`` < ``record_b``. Distinct texts of a class meet first; the records of two different
    texts then meet over SALT parts of the one side, so neither copies of one text nor one large class
    are compared in vain or in one task. Blank forms are no case.
    """
    classes = cut(look_alike_classes(forms).select("field", "record", "class", "text").distinct())
    texts = classes.select("field", "class", "text").distinct()
    other = texts.withColumnRenamed("text", "other")
    met = texts.join(other, ["field", "class"]).where("text < other")
    salted = met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    side = lambda t, r: classes.select("field", "class", F.col("text").alias(t), F.col("record").alias(r))
    left = side("text", "x").withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALT)).cast("int"))
    pairs = left.join(salted, ["field", "class", "text", "salt"]).join(side("other", "y"), ["field", "class", "other"]).where("x <> y")
    return pairs.select("field", F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b")).distinct()
