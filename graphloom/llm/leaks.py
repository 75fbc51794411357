"""Evaluation texts inside a corpus, found by template windows with typed slots."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

#: Words in a window. With single words replaced, longer windows lose whole passages.
WINDOW = 4
#: A page leaks an item if windows found in it cover this share of the item's words…
MIN_COVER = 0.38
#: … or if its template covers this share and every slot is renamed in one way only.
MIN_TEMPLATE, MIN_CONSISTENT = 0.8, 0.9
#: Up to so many windows of items (of about 100 bytes) the item side is broadcast, else shuffled.
BROADCAST_WINDOWS = 300_000

# Number words by language (one, where it is an article too, left out) and units.
_TENS = {
    "en": "twenty thirty forty fifty sixty seventy eighty ninety".split(),
    "de": "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split(),
    "fr": "vingt trente quarante cinquante soixante septante octante nonante".split(),
    "es": "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa".split(),
}
_SMALL = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(),
    "de": "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split(),
    "fr": "zéro deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize".split(),
    "es": "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince".split(),
}
_LARGE = {"en": "hundred thousand million billion dozen".split(), "de": "hundert tausend million millionen".split(), "fr": "mille million millions douzaine".split(), "es": "ciento mil millón millones docena".split()}
_JOINED = {"en": "{ten}{one}", "de": "{one}und{ten}", "fr": "{ten}{one}", "es": "veinti{one}"}
#: Number words of each language, compound ones by rule; hyphens within words are removed first.
NUMBER_WORDS = {k: frozenset(_SMALL[k] + _TENS[k] + _LARGE[k] + [_JOINED[k].format(ten=t, one="ein" if o == "eins" else o) for t in _TENS[k] for o in _SMALL[k][1:10]]) for k in _TENS}
UNITS = frozenset("second seconds minute minutes hour hours day days week weeks month months year years percent cent mm cm km kg mg kb mb gb tb metre metres meter meters mile miles gram grams litre litres dollar dollars euro euros".split())

_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_HIDDEN = re.compile(r"[­​-‏⁠﻿]")
_BROKEN = re.compile(r"(?<=\w)-[ \t]*(?:\r\n|\r|\n)[ \t>|*]*(?=\w)")
_INNER = re.compile(r"(?<=\w)[-'’‑](?=\w)")
_ESCAPED = re.compile(r"\\[nrt]")
#: A word, and what stands before it if that begins a sentence or a line.
_WORD = re.compile(r"(^\s*|[.!?:;\"“”(\n]\s*|\s{4,})?([^\W_]+)")
#: Words of which a worker keeps what it knows.
WORDS_KEPT = 1 << 17


def _clean(text: str) -> str:
    """Text without tags, escapes, hidden characters and broken or joined words."""
    if "&" in text or "<" in text:
        text = _TAG.sub(" ", html.unescape(text))
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    if "\\" in text:
        text = _ESCAPED.sub("\n", text)
    return _INNER.sub("", _BROKEN.sub("", text))


def tokens(text: str) -> list[tuple[str, bool]]:
    """Words without layout, and whether each owes a capital it has to its place."""
    return [(word, bool(before)) for before, word in _WORD.findall(_clean(text))]


def _writings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        upper, lower = Counter(), Counter()
        for text in batch.column(0).to_pylist():
            for word, first in tokens(text):
                if word[0].islower():
                    lower[word] += 1
                elif word[0].isupper() and not first:
                    upper[word.lower()] += 1
        words = sorted(set(upper) | set(lower))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([upper[w] for w in words], pa.int64()), pa.array([lower[w] for w in words], pa.int64())], names=["word", "upper", "lower"])


def item_names(texts: DataFrame, text_col: str) -> frozenset[str]:
    """Words that the texts write with a capital inside sentences and never without.

    Counted where the texts are; only the names come to the driver, part of the items' vocabulary.
    """
    seen = texts.select(text_col).mapInArrow(_writings, "word string, upper bigint, lower bigint").groupBy("word").agg(F.sum("upper").alias("upper"), F.sum("lower").alias("lower"))
    return frozenset(r[0] for r in seen.where("upper > 0 AND lower = 0").select("word").collect())


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


class Canon:
    """Words as codes: of the word, and of the slot or word in its place; what is known of a word is
    kept, for up to WORDS_KEPT words at a time."""

    def __init__(self, names: frozenset[str], numbers: frozenset[str]) -> None:
        self.names, self.numbers, self.kept = names, numbers, {}
        self.slots = {k: _hash(k) for k in ("<number>", "<name>", "<unit>")}

    def _tell(self, word: str) -> tuple[str, int, str, bool, bool]:
        low = word.lower()
        slot = "<number>" if low[0].isdigit() or low in self.numbers else "<name>" if low in self.names else "<unit>" if low in UNITS else ""
        all_upper = word.isupper()
        # a capital inside a sentence makes a name of a unit too, but not of a number
        told = low, _hash(low), slot, word[0].isupper() and not all_upper and slot in ("", "<unit>"), all_upper
        if len(self.kept) >= WORDS_KEPT:
            self.kept.clear()
        self.kept[word] = told
        return told

    def read(self, text: str) -> tuple[list[str], list[str], list[int], list[int]]:
        """Of each word: itself in lower case, its slot or '', the code of the word and that of the
        slot or word. Numbers, names and units become typed placeholders; capitals inside sentences
        tell names, unless most words are all capitals."""
        found = _WORD.findall(_clean(text))
        get, tell = self.kept.get, self._tell
        told = [get(word) or tell(word) for _, word in found]
        shouted = sum(t[4] for t in told) * 2 > len(told)
        name = "<name>"
        slots = [t[2] for t in told] if shouted else [name if t[3] and not before else t[2] for t, (before, _) in zip(told, found, strict=True)]
        codes = [t[1] for t in told]
        by_slot = self.slots
        return [t[0] for t in told], slots, codes, [by_slot[k] if k else c for k, c in zip(slots, codes, strict=True)]


def _rolled(codes: list[int], width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` words."""
    each = np.array(codes, np.uint64)
    out = np.zeros(len(each) - width + 1, np.uint64)
    for k in range(width):
        out = out * _FACTOR + each[k : k + len(out)]
    return out ^ (out >> np.uint64(29))


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
WINDOWS = "id bigint, size int, at int, template bigint, exact bigint, slots string"
_ARROW = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("at", pa.int32()), ("template", pa.int64()), ("exact", pa.int64()), ("slots", pa.string())])
#: Texts whose windows are sent on together; bounds a worker's memory.
TEXTS_A_BATCH = 250


def _windower(names: frozenset[str], numbers: frozenset[str], width: int, wanted: np.ndarray | None):
    canon = Canon(names, numbers)

    def windows(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        slots: list[str] = []
        for doc, text in zip(ids, texts, strict=True):
            words, kinds, codes, places = canon.read(text)
            w = min(width, len(words))
            if not w or (wanted is not None and not len(wanted)):
                continue
            template = _rolled(places, w)
            told = np.ones(len(template), bool) if wanted is None else wanted[np.searchsorted(wanted, template).clip(max=len(wanted) - 1)] == template
            if not told.any():
                continue
            slot = np.cumsum([0, *map(bool, kinds)])
            keep = np.flatnonzero(told & (slot[w:] - slot[:-w] < w))  # a window of slots alone says nothing
            if not len(keep):
                continue
            exact = _rolled(codes, w)
            if wanted is not None:
                keep = keep[np.unique(exact[keep], return_index=True)[1]]  # what a page repeats counts once
            for col, values in zip(cols, (np.full(len(keep), doc, np.int64), np.full(len(keep), len(words), np.int32), keep.astype(np.int32), template[keep].view(np.int64), exact[keep].view(np.int64)), strict=True):
                col.append(values)
            slots += [" ".join(words[i] for i in range(k, k + w) if kinds[i]) for k in keep]
        arrays = [pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(cols, _ARROW, strict=False)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(slots, pa.string())], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_A_BATCH):
                part = batch.slice(start, TEXTS_A_BATCH)
                yield windows(part.column(0).to_pylist(), part.column(1).to_pylist())

    return run


def template_windows(texts: DataFrame, id_col: str, text_col: str, names: frozenset[str], numbers: frozenset[str], width: int = WINDOW, wanted: np.ndarray | None = None) -> DataFrame:
    """Windows of every text that hold at least one plain word (or those whose template is ``wanted``,
    each once a text): place, hash of the template, hash of the words, the words in the slots."""
    rows = texts.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_windower(names, numbers, width, wanted), WINDOWS)


def _covers(places: set[int], width: int) -> int:
    """How many words the windows at ``places`` cover together."""
    last, n = -width, 0
    for at in sorted(places):
        n += min(width, at - last)
        last = at
    return n


def judge(size: int, width: int, met: list[tuple[int, str, str]]) -> tuple[float, float, float]:
    """(``covered``, ``template``, ``consistent``) of an item of ``size`` words from the windows that
    it shares with a page: (place in the item, words in the item's slots, words in the page's).

    Every slot word of the item maps to the page's word that most of its windows give it, itself
    first among equals. ``covered`` is the share of the item inside windows whose slots all map to
    themselves, ``template`` that inside windows which keep to the mapping, ``consistent`` the share
    of slot words with a single rendering.
    """
    width = min(width, size)
    votes: dict[str, Counter] = {}
    pairs = [(at, list(zip(own.split(), other.split(), strict=False))) for at, own, other in met]
    for a, b in ((a, b) for _, slots in pairs for a, b in set(slots)):
        votes.setdefault(a, Counter())[b] += 1
    best = {a: min(c, key=lambda b, a=a, c=c: (-c[b], b != a, b)) for a, c in votes.items()}
    same = {at for at, slots in pairs if all(a == b for a, b in slots)}
    kept = {at for at, slots in pairs if all(best[a] == b for a, b in slots)}
    single = sum(len(c) == 1 for c in votes.values()) / len(votes) if votes else 1.0
    return _covers(same, width) / size, _covers(kept, width) / size, single


def _judged(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["id"], r["item_id"], *judge(r["words"], width, [(m["at"], m["item_slots"], m["slots"]) for m in r["met"]])) for r in batch.to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), batch.schema.field("item_id").type, pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "covered", "template", "consistent"])

    return run


def leaks(
    corpus: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, numbers: dict[str, frozenset[str]] | None = None
) -> DataFrame:
    """(``doc_id``, ``item_id``, ``covered``, ``template``, ``consistent``) of pages that leak items.

    All windows of all pages are hash-joined with those of the items by their templates, in which
    numbers, names and units are typed slots, and the slots decide (``judge``): a page leaks an item
    if windows in which every slot maps to itself (the text as it is, or passages of it) cover
    MIN_COVER of it, or if windows that keep to one renaming cover MIN_TEMPLATE and at least
    MIN_CONSISTENT of the slot words have one rendering (the question with other numbers and names).
    Each window counts once, so what a page repeats counts no more. Windows of slots alone are left
    out on both sides: they are the same for any row of numbers. ``numbers`` has the number words of
    each language (NUMBER_WORDS if None).

    While the items' windows are few (the number is checked), what can't match is dropped where it is
    made and the rest joined by broadcast, else by shuffle. A page's matches combine before they are
    shuffled, and pairs that share too few windows to reach MIN_COVER are dropped before they are
    judged. Null ids and texts are left out; texts shorter than a window make one window; repeated
    rows give one result; extra columns are ignored; an empty side gives no rows.
    """
    questions = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias(item_id), item_text)
    names, words = item_names(questions, item_text), frozenset().union(*(NUMBER_WORDS if numbers is None else numbers).values())
    known = cut(template_windows(questions, item_id, item_text, names, words, width).select(F.col("id").alias("item_id"), F.col("size").alias("words"), "at", "template", F.col("slots").alias("item_slots")))
    few = known.count() <= BROADCAST_WINDOWS
    wanted = np.unique(np.fromiter((r[0] for r in known.select("template").toLocalIterator()), np.int64).view(np.uint64)) if few else None
    met = template_windows(corpus, doc_id, doc_text, names, words, width, wanted).select("id", "template", "slots").join(F.broadcast(known) if few else known, "template")
    pairs = met.groupBy("id", "item_id").agg(F.min("words").alias("words"), F.collect_set(F.struct("at", "item_slots", "slots")).alias("met"))
    near = pairs.where(F.size(F.array_distinct("met.at")) * F.least(F.lit(width), F.col("words")) >= MIN_COVER * F.col("words"))
    judged = near.mapInArrow(_judged(width), "doc_id bigint, item_id bigint, covered double, template double, consistent double")
    return judged.where((F.col("covered") >= MIN_COVER) | ((F.col("template") >= MIN_TEMPLATE) & (F.col("consistent") >= MIN_CONSISTENT)))
