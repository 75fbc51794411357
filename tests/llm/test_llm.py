"""Training-data operators against brute force, planted cases and awkward input."""

import itertools
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import leaks, lookalike, merkle, metric, names, packing, pairs, queries, spam


# look-alikes ---------------------------------------------------------------------------------


def test_look_alikes(spark):
    rows = [
        (1, "title", "Graph science of cafés"), (2, "title", "Grарh ѕcience of cafés"), (3, "title", "Ｇraph sci​ence of　cafés"),
        (4, "title", "graph science of cafés"), (5, "title", "Graph science of cafes"), (6, "title", "сети с графом"), (7, "title", "cети c графом"),
        (1, "title", "Graph science of cafés"), (8, "title", None), (9, "title", " "), (10, "title", " "), (11, "title", "x" * 50_000), (12, "author", "Graph science of cafés"),
    ]
    texts = spark.createDataFrame(rows, "id long, field string, raw string").withColumn("form", F.lit("clash"))
    found = {tuple(r) for r in lookalike.visually_equal(lookalike.consistent_forms(texts)).collect()}
    assert found == {("title", a, b) for a, b in ((1, 2), (1, 3), (2, 3), (6, 7))}
    alone = {tuple(r) for r in lookalike.visually_equal(lookalike.consistent_forms(texts, known_only=True)).collect()}
    assert alone == {("title", a, b) for a, b in ((1, 2), (1, 3), (2, 3))}  # "с" alone in Latin letters is wholly of another script
    classes = {(r["record"], r["texts"], r["records"]) for r in lookalike.look_alike_classes(lookalike.consistent_forms(texts)).collect()}
    assert classes == {(1, 3, 3), (2, 3, 3), (3, 3, 3), (6, 2, 2), (7, 2, 2)}
    assert lookalike.consistent_forms(texts.limit(0)).count() == 0


def test_sole_authors_have_forms_and_tell_words(spark, tmp_path):
    latin, mixed = ("Ann", "Zorbek"), ("Ann", "Zоrbek")  # Cyrillic о
    rows = [(1, [latin]), (2, [mixed]), (3, [("Bo", "Li"), mixed]), (4, [("Bo", "Li"), ("Ann", "Zо\u200brbek")]), (5, None), (6, [])]
    message = "id long, message struct<title: array<string>, author: array<struct<given: string, family: string>>>"
    works = spark.createDataFrame([(i, (["One"], people)) for i, people in rows], message).withColumnRenamed("id", "record_id")
    works.write.parquet(str(tmp_path / "crossref_works.parquet"))
    forms = {(r["record_id"], r["form"]) for r in queries.p2_forms(spark, str(tmp_path)).where("field = 'author'").collect()}
    assert forms == {(1, "Ann|Zorbek"), (2, "Ann|Zorbek"), (3, "Bo|Li|Ann|Zorbek"), (4, "Bo|Li|Ann|Zorbek")}  # the word is known from 1 only
    assert {tuple(r) for r in queries.p2_found(spark, str(tmp_path)).collect()} == {("author", 3, 4)}


# formatting copies ---------------------------------------------------------------------------


def test_formatting_copies(spark):
    a = {"DOI": "10.1/ab", "title": ["A b, c."], "n": 3, "author": [{"given": "X", "family": "Y"}, {"given": "Z"}]}
    b = {"author": [{"family": "y ", "given": "x"}, {"given": "z"}], "n": 3, "title": ["a  B C"], "DOI": "https://doi.org/10.1/AB"}
    c = {**a, "author": a["author"][::-1]}
    texts = [(1, json.dumps(a)), (2, json.dumps(b, indent=2)), (3, json.dumps(c)), (4, json.dumps({**a, "n": 4})), (5, '{"n": null}'), (6, "{}"), (7, '{"n": ""}'), (8, "{broken"), (9, None), (1, json.dumps(a)), (None, json.dumps(a)), (10, json.dumps({"message": b}))]
    df = spark.createDataFrame([("t", i, x, "k") for i, x in texts], "tbl string, id long, json string, digest string")
    assert {tuple(r) for r in merkle.formatting_copies(df, "message").collect()} == {("t", 1, 2), ("t", 1, 10)}
    kept = {r["keep_id"]: r["n_copies"] for r in merkle.collapsed(df, "message").collect()}
    assert kept == {1: 2, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0}
    assert merkle.formatting_copies(df.limit(0)).count() == 0


def test_equal_digests_of_different_records_are_told_apart(spark, monkeypatch):
    df = spark.createDataFrame([("t", i, json.dumps({"a": x})) for i, x in ((1, "p"), (2, "q"), (3, "P"), (4, "Q!"))], "tbl string, id long, json string")
    real = merkle._digester

    def colliding(envelope):
        run = real(envelope)
        return lambda batches: (f.assign(digest=[b"same"] * len(f)) for f in run(batches))

    monkeypatch.setattr(merkle, "_digester", colliding)
    assert {tuple(r) for r in merkle.formatting_copies(df).collect()} == {("t", 1, 3), ("t", 2, 4)}


# names ---------------------------------------------------------------------------------------


def test_name_variants(spark):
    at = "Salehaven University"
    rows = [
        (1, "Katherine M.", "Zeleborn", at), (2, "Kate", "Zeleborn", "Salehaven Univ."), (3, None, "Zeleborn, Katherine", at), (4, "Zeleborn", "Katherine", at), (5, "K.", "Zelborn", at), (6, "Prof. Katherine", "ZELEBORN, PhD", None),
        (7, "Katherine", "Zeleborn", "Gorabridge Polytechnic"), (8, "Karl", "Hartwick", at), (9, "Kurt", "Hartwick", at), (10, "K.", "Hartwick", at), (11, "Jürgen", "Bransteböm", at), (12, "Juergen", "Branstebm", at), (13, "Jurgen", "Bransteboem", at),
        (14, None, "Linaxbel Institute of Applied Topology", None), (15, None, "Institute of Applied Topology, Linaxbel", None), (16, None, "Linaxbel IAT", None), (17, None, "Linaxbel Working Group", None), (18, None, None, None), (None, "A", "B", at), (19, " ", "", at), (1, "Katherine M.", "Zeleborn", at),
    ]
    df = spark.createDataFrame([(i, g, f, " ".join(x for x in (g, f) if x) or None, a, "c") for i, g, f, a in rows], "author_no long, given string, family string, name string, affiliation string, entity string")
    groups: dict = {}
    linked = names.entities(df)
    for r in linked.collect():
        groups.setdefault(r["entity"], set()).add(r["author_no"])
    found = {frozenset(g) for g in groups.values() if len(g) > 1}
    # 6 has no institution and fits the group of 1 and that of 7, so it stays alone; so does 10 between 8 and 9
    assert found == {frozenset({1, 2, 3, 4, 5}), frozenset({11, 12, 13}), frozenset({14, 15, 16})}
    assert names.same_entity_pairs(linked).count() == 10 + 3 + 3
    assert names.entities(df.limit(0)).count() == 0


def test_radius_join_against_brute_force_and_a_deletion_index(spark, monkeypatch):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(9))) for _ in range(260)})
    rows = [("x", w) for w in words] + [("y", w) for w in words[::3]] + [(None, "a"), ("z", None)]
    points = spark.createDataFrame(rows, "block string, name string").withColumn("radius", F.lit(1))
    for cell in (1, 1000):
        monkeypatch.setattr(metric, "ONE_CELL", cell)
        got = {(r["block"], r["a"], r["b"]) for r in metric.radius_pairs(points).collect()}
        cut_out = lambda w: {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}
        for g, own in (("x", words), ("y", words[::3])):
            want = {(a, b) for a in own for b in own if names.edit_distance(a, b, 1) <= 1}
            assert {(a, b) for k, a, b in got if k == g} == want
            assert all(cut_out(a) & cut_out(b) for a, b in want)  # each pair would also meet in an index of deletions
    far = points.withColumn("radius", F.lit(2))
    two = {(r["a"], r["b"]): r["d"] for r in metric.radius_pairs(far.where("block = 'x'"), far.where("block = 'y'").withColumn("block", F.lit("x"))).collect()}
    plain = lambda a, b: min(names.edit_distance(a, b, 2), 3)
    got = {k for k, d in two.items() if d < 2}
    assert got == {(a, b) for a in words[::3] for b in words if names.edit_distance(a, b, 1) <= 1}
    assert {k for k in two if plain(*k) > 2} == set() and len(two) > len(got)
    assert metric.radius_pairs(points.limit(0)).count() == 0


def test_radius_join_keeps_only_pivots_in_reach(spark, monkeypatch):
    monkeypatch.setattr(metric, "ONE_CELL", 1)
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(900)})
    words = sorted({*words, *(w[:2] + w[3] + w[2] + w[4:] for w in words[:9]), words[1] + "a"})
    points = spark.createDataFrame([("x", w) for w in words], "block string, name string").withColumn("radius", F.lit(1))
    pivots = metric._pivots(points.select("block", "name"), [])
    flagged = points.withColumn("holds", F.lit(True)).withColumn("asks", F.col("name") < "c")
    placed = metric._placed(flagged, pivots, []).select("asks", F.size("reach").alias("n")).collect()
    every = len(pivots.first()["pivots"])
    assert every > 30 and max(r["n"] for r in placed) < every  # distances to pivots out of reach are not kept
    assert sum(r["n"] for r in placed if not r["asks"]) < 0.2 * every * len(words)
    found = metric.radius_pairs(points.unionByName(points), points.where("name < 'c'").unionByName(points.where("name < 'b'")))
    got = [(r["a"], r["b"]) for r in found.collect()]
    assert sorted(got) == sorted((a, b) for a in words if a < "c" for b in words if names.edit_distance(a, b, 1) <= 1)  # each once
    assert found._jdf.queryExecution().optimizedPlan().constraints().isEmpty()  # else planning of later joins takes the driver's memory


def test_long_names_two_edits_apart_and_learnt_nicknames(spark):
    rows = [(1, "Karl", "Hartwickson", "Inst A"), (2, "Karl", "Hartvicson", "Inst A"), (3, "K.", "Hartvikson", "Inst B"), (4, "Karl", "Hartwickson", "Inst B"), (5, "Karl", "Hart", "Inst A"), (6, "Karl", "Harp", "Inst A")]
    rows += [(10 + 2 * k + j, n, f"Qua{c}{c}umel", f"Inst {c}") for k, c in enumerate("bdfg") for j, n in enumerate(("Ferapontina", "Fonty"))]
    rows += [(30, "Fonty", "Velgrome", "Inst A"), (31, "Ferapontina", "Velgrome", "Inst A"), (32, "Bob", "Zagore", "Inst A"), (33, "Robert", "Zagore", "Inst A")]
    authors = spark.createDataFrame([(n, g, f, f"{g} {f}", a) for n, g, f, a in rows], "author_no long, given string, family string, name string, affiliation string")
    found = {tuple(r) for r in names.same_entity_pairs(names.entities(authors)).collect()}
    assert found == {(1, 2), (5, 6), (30, 31), (32, 33)} | {(10 + 2 * k, 11 + 2 * k) for k in range(4)}


# pairs ---------------------------------------------------------------------------------------


def test_pairs_against_brute_force(spark):
    rnd = random.Random(1)
    baskets = [(b, [rnd.choice(["x", " x ", "y", "z", "hot", "", None, "é"]) for _ in range(rnd.randrange(6))]) for b in range(60)] + [(3, ["hot", "y"]), (None, ["x", "y"]), (70, None)]
    sets: dict = {}
    for b, items in baskets:
        if b is not None:
            sets.setdefault(b, set()).update(i.strip() for i in items or [] if i and i.strip())
    want = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    df = spark.createDataFrame([(*b, 1) for b in baskets], "basket long, items array<string>, item int")
    got = {(r["item_a"], r["item_b"]): r for r in pairs.associations(df, "basket", "items").collect()}
    assert {k: r["n"] for k, r in got.items()} == dict(want)
    one = Counter(i for s in sets.values() for i in s)
    for (a, b), r in got.items():
        n, na, nb, t = want[a, b], one[a], one[b], len(sets)
        assert (r["n_a"], r["n_b"], r["total"]) == (na, nb, t)
        assert r["odds_ratio"] == pytest.approx((n + 0.5) * (t - na - nb + n + 0.5) / ((na - n + 0.5) * (nb - n + 0.5)))
    assert pairs.associations(df.limit(0), "basket", "items").count() == 0


def test_large_baskets_are_split(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PIECE", 7)
    baskets = [(1, [f"i{k}" for k in range(40)]), (2, ["i1", "i2"]), (3, [f"i{k}" for k in range(5, 15)])]
    want = Counter(p for _, s in baskets for p in itertools.combinations(sorted(s), 2))
    got = {(r["item_a"], r["item_b"]): r["n"] for r in pairs.associations(spark.createDataFrame(baskets, "basket long, items array<string>"), "basket", "items").collect()}
    assert got == dict(want)


def test_symbols_are_no_formatting(spark):
    rows = [(1, "Learning C++"), (2, "learning  C"), (3, "p < 0.05"), (4, "p > 0.05"), (5, "Learning, C++")]
    df = spark.createDataFrame([("t", i, json.dumps({"title": x})) for i, x in rows], "tbl string, id long, json string")
    assert [tuple(r) for r in merkle.formatting_copies(df).collect()] == [("t", 1, 5)]


def test_run_lengths_across_batches():
    import pyarrow as pa

    codes = np.sort(np.random.default_rng(0).integers(0, 40, 1000))
    batches = [pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.ones(len(c), np.int64))], schema=pairs.RUN_SCHEMA) for c in np.array_split(codes, 37)] + [pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, schema=pairs.RUN_SCHEMA)]
    got = [(c, n) for b in pairs.run_lengths(iter(batches)) for c, n in zip(*b.to_pydict().values(), strict=True)]
    assert got == sorted(Counter(codes.tolist()).items())


# packing -------------------------------------------------------------------------------------


def test_packing_matches_plain_best_fit(spark):
    rnd = random.Random(4)
    for capacity in (1, 7, 100):
        sizes = [rnd.randrange(capacity + 1) for _ in range(300)]
        room: list[int] = []
        want = {}
        for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fits = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
            b = min(fits)[1] if fits else len(room)
            if not fits:
                room.append(capacity)
            room[b] -= sizes[i]
            want[i] = b
        got = packing.best_fit_decreasing(sizes, capacity)
        load = Counter()
        for s, b in zip(sizes, got, strict=True):
            load[b] += s
        assert max(load.values()) <= capacity and len(load) == len(room)
    rows = [(i, s) for i, s in enumerate([10, 25, 0, 3, None, -2, 10, 7])] + [(None, 5), (6, 10)]
    packed = packing.pack(spark.createDataFrame([(*r, 1) for r in rows], "d long, n long, size int"), "d", "n", 10)
    assert packed.groupBy("container").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] <= 10
    assert packed.agg(F.sum("size")).first()[0] == 70 and packed.where("doc_id = 1").count() == 3 and packed.count() == len(rows) + 2
    blocks = packing.pack(spark.range(1000).withColumn("n", F.col("id") % 9 + 1), "id", "n", 10, block_rows=300)
    assert blocks.groupBy("container").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] <= 10 and blocks.select("doc_id").distinct().count() == 1000
    assert packing.pack(spark.createDataFrame([], "d long, n long"), "d", "n", 10).count() == 0
    # blocks lose next to nothing, and large ids beside nulls stay exact
    many = spark.range(6000).select((F.col("id") + 2**60).alias("id"), (F.pmod(F.xxhash64("id"), F.lit(700)) + 1).alias("n")).unionByName(spark.createDataFrame([(None, 5)], "id long, n long"))
    apart = packing.pack(many, "id", "n", 1000, block_rows=400)
    report = packing.packing_report(apart, 1000).first()
    assert report["fullest"] <= 1000 and report["pieces"] == 6001 and apart.select("doc_id").distinct().count() == 6001 and apart.where("doc_id IS NULL").count() == 1
    assert report["containers"] <= packing.packing_report(packing.pack(many, "id", "n", 1000), 1000).first()["containers"] * 1.01 + 1
    same = spark.range(20_000).select(F.lit(7).alias("id"), F.lit(3).alias("n"))
    assert packing.packing_report(packing.pack(same, "id", "n", 10, block_rows=2000), 10).first()["containers"] <= 6700


# leaks ---------------------------------------------------------------------------------------

ITEM = "Suppose that Moritnex and Praivdor share forty-two stable hands by council order. The painted register of Velortra lists fifty hollow postal sacks; they stand opposite Bolortum. Count twin attic rooms."


def test_leaks(spark):
    other = "In Voratra, weighted edges reveal how gilded tram depots exchange letters through retired canal locks. Name the shortest tour near Jaxemar during fairs."
    prose = "The import job waited for readers outside the field. " * 3
    broken = ITEM.replace("council order", "coun-\n> cil order").replace("painted", "<b>painted</b>").upper()
    swapped = " ".join(w if i % 7 else "indeed" for i, w in enumerate(ITEM.split()))
    moved = ITEM.replace("Moritnex", "Zeloria").replace("Praivdor", "Kanteno").replace("forty-two", "seven").replace("fifty", "ninety").replace("Velortra", "Dorabel").replace("Bolortum", "Hexitra")
    docs = [(1, prose + ITEM + prose), (2, prose + broken), (3, prose + swapped), (4, prose + moved + prose), (5, prose + "share stable hands by council order"), (6, ITEM[: len(ITEM) // 2 + 10] + prose), (7, prose), (8, None), (9, ""), (None, ITEM), (10, other + prose * 400), (1, prose + ITEM + prose)]
    corpus = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, template int")
    items = spark.createDataFrame([(1, ITEM), (2, other), (3, None), (4, "")], "item_id long, text string")
    want = {(1, 1), (2, 1), (3, 1), (4, 1), (6, 1), (10, 2)}
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(corpus, items).collect()} == want
    assert leaks.leaks(corpus.limit(0), items).count() == leaks.leaks(corpus, items.limit(0)).count() == 0


def test_leaks_by_shuffle_join(spark, monkeypatch):
    corpus = spark.createDataFrame([(1, ITEM), (2, "nothing of the kind here at all")], "doc_id long, text string")
    monkeypatch.setattr(leaks, "BROADCAST_WINDOWS", 0)
    assert [tuple(r)[:2] for r in leaks.leaks(corpus, spark.createDataFrame([(5, ITEM)], "item_id long, text string")).collect()] == [(1, 5)]


def test_slots_decide(spark):
    assert leaks.judge(8, 4, [(0, "two", "two"), (4, "", "")]) == (1.0, 1.0, 1.0)
    assert leaks.judge(8, 4, [(0, "two", "six"), (1, "two", "six"), (4, "rome", "oslo"), (5, "two", "nine")]) == (0.0, 1.0, 0.5)
    assert leaks.judge(3, 4, [(0, "", "")]) == (1.0, 1.0, 1.0)
    numbers = " ".join(str(n) for n in range(3000))
    corpus = spark.createDataFrame([(1, numbers), (2, "Zwanzig Karten liegen auf fünfundzwanzig Tischen neben dem roten Haus am Markt"), (3, ITEM.replace("<", ""))], "doc_id long, text string")
    items = spark.createDataFrame([(1, "1 2 3 4 5 6"), (2, "Dreißig Karten liegen auf siebzig Tischen neben dem roten Haus am Markt")], "item_id long, text string")
    # rows of numbers are no text; the same question with other numbers is one
    assert [tuple(r)[:2] for r in leaks.leaks(corpus, items).collect()] == [(2, 2)]


# spam ----------------------------------------------------------------------------------------


def test_spam(spark):
    rnd = random.Random(6)
    subject = ["the planner", "a small team", "the index", "the operator", "this section", "one partition"]
    verb = ["merges", "samples", "rejects", "confirms", "delays", "rebuilds", "filters"]
    rest = ["the totals for most venues", "a sampled estimator in the northern sample", "the edges of a graph after the import", "the results on a single machine", "what the readers asked for"]
    prose = lambda n: " ".join(f"{rnd.choice(subject).capitalize()} {rnd.choice(verb)} {rnd.choice(rest)}." for _ in range(n))
    keys = ["cheap hosting", "link builder", "doi lookup", "csv converter"]
    docs = [(i, prose(rnd.randrange(5, 30)), "en") for i in range(80)]
    docs += [(100, ", ".join(rnd.choice(keys) for _ in range(60)), "en"), (101, " ".join(f"https://{rnd.choice('abcde')}-shop.example/{rnd.choice(keys).replace(' ', '_')}" for _ in range(40)), None), (102, prose(2) + " " + " ".join("#" + rnd.choice(keys).replace(" ", "") for _ in range(70)), "en")]
    docs += [(200, prose(25) + "\n" + "\n".join(f"https://x{k}.example/a" for k in range(4)), "en"), (201, "Cheap", "en"), (202, None, "en"), (203, "", None), (None, "buy " * 50, "en"), (204, prose(300), "en")]
    pages = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, score int")
    assert {r["doc_id"] for r in spam.spam_pages(pages).collect()} == {100, 101, 102}
    assert spam.spam_pages(pages.limit(0)).count() == 0


def _prose(rnd, n):
    subject = ["the planner", "a small team", "the index", "the operator", "this section", "one partition"]
    verb = ["merges", "samples", "rejects", "confirms", "delays", "rebuilds", "filters"]
    rest = ["the totals for most venues", "a sampled estimator in the northern sample", "the edges of a graph after the import", "the results on a single machine", "what the readers asked for"]
    return " ".join(f"{rnd.choice(subject).capitalize()} {rnd.choice(verb)} {rnd.choice(rest)}." for _ in range(n))


def test_spam_reposted_by_a_third_of_all_pages(spark):
    rnd = random.Random(7)
    keys = ["cheap hosting", "link builder", "doi lookup", "csv converter"]
    docs = [(i, _prose(rnd, rnd.randrange(5, 30)), "en") for i in range(80)]
    docs += [(100, ", ".join(rnd.choice(keys) for _ in range(60)), "en"), (101, " ".join(f"https://{rnd.choice('abcde')}-shop.example/{rnd.choice(keys).replace(' ', '_')}" for _ in range(40)), None)]
    copied = ", ".join(rnd.choice(keys) for _ in range(70))
    docs += [(200 + i, copied, None if i % 3 == 0 else "en") for i in range(45)]
    pages = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in spam.spam_pages(pages).collect()} == {100, 101} | {200 + i for i in range(45)}


def test_spam_without_a_language(spark):
    rnd = random.Random(8)
    docs = [(i, _prose(rnd, rnd.randrange(5, 30)), "en") for i in range(80)]
    tags = " ".join("#" + rnd.choice(["billig", "kaufen", "gratis", "rabatt"]) for _ in range(70))
    docs += [(100, tags, None), (101, tags + " #neu", "xx")]
    pages = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in spam.spam_pages(pages).collect()} == {100, 101}
    prose = spark.createDataFrame([(i, _prose(rnd, 10), None) for i in range(10)], "doc_id long, text string, lang string")
    assert spam.spam_pages(prose).count() == 0


def test_particles_shortened_exchanged_or_glued(spark):
    rows = [
        (1, "Emre", "v.d. Olmomidski", "Inst A"), (2, "Emre A.", "van der Olmomidski", "Inst A"), (3, "Emre", "Vanderolmomidski", "Inst A"),
        (4, "Gustav", "la Feromabwald", "Inst B"), (5, "Gustav", "al Feromabwald", "Inst B"),
        (6, "Eitan", "la Kalegüller, PhD", "Inst C"), (7, "Eitan", "Lakalegüller", "Inst C"),
        (8, "Greta", "v. Lanekonoff", "Inst D"), (9, "Greta", "von Lanekonoff", "Inst D"), (10, "Greta", "Lanekonoff", "Inst E"),
        (11, "Anna", "Dvorak", "Inst F"), (12, "Anna", "Vorakis", "Inst F"),
    ]
    authors = spark.createDataFrame([(n, g, f, f"{g} {f}", a) for n, g, f, a in rows], "author_no long, given string, family string, name string, affiliation string")
    found = {tuple(r) for r in names.same_entity_pairs(names.entities(authors)).collect()}
    assert found == {(1, 2), (1, 3), (2, 3), (4, 5), (6, 7), (8, 9)}
    assert [names.family_words(t) for t in ("V. d. Berg", "vd Berg", "d. Berg", "Berg", "Ed", "Vdovin", "V.")] == [["berg"]] * 4 + [["ed"], ["vdovin"], ["v"]]
