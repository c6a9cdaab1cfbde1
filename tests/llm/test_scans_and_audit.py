"""License scans, spelling variants and the filter audit against brute force and SQL, with odd rows."""

import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandtable.llm import audit, licenses, queries, spelling
from tests.test_queries import plain

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
CLASHES = ("n", "word", "key", "pivot", "part", "mask", "digest", "good", "first", "least", "label", "rank", "side", "words", "score", "_id", "_digest", "quality")


@pytest.fixture
def odd(spark):
    rows = [(1, "Mit License", "s"), (1, "Mit License", "s"), (2, None, None), (3, "", "s"), (None, "x y", "t"), (None, "", ""), (4, LONG, "t"), (5, "  \t\n ", None), (6, "A b C d|", "é"), (7, "a" * 5000, "é")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in CLASHES})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = c.execute(queries.ORACLE[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == sorted(df.columns)
    return sorted(tuple(plain(r[x]) for x in named) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in cursor.fetchall())


# License scans


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and (c.isdigit() or c.islower()) or ord(c) > 127 else " " for c in low).split(" ")


def plain_scan(text):
    words = [w for w in plain_words(text) if w]
    found = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


def test_license_phrases_by_brute_force(spark):
    want = {r.doc_id: plain_scan(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op11_licenses(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == want
    assert sum(v[1] for v in want.values()) > 20
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} for r in rows)
    assert any(r.labels == "cc-by-nc" and r.base_labels == "" for r in rows)


def test_every_notice_is_found_whole_edited_and_among_other_words(spark):
    filler = " ".join(f"filler{i}" for i in range(300))
    rows, want = [], {}
    for k, (label, (text, keys)) in enumerate(licenses.NOTICES.items()):
        words = text.split()
        held = {w for phrase in keys for w in phrase.split()}
        spare = next((i for i in range(len(words) - 1, 0, -1) if licenses.words_of(words[i]) and not held & {x.decode() for x in licenses.words_of(words[i])}), None)
        edited = [*words[:spare], "changed", *words[spare + 1 :]] if spare and len(words) > 12 else words
        for j, made in enumerate((text, f"{filler} {' '.join(edited)} {filler} {text.upper()}", f"{filler} {' '.join(reversed(words))}")):
            rows.append((10 * k + j, made))
            want[10 * k + j] = label if j < 2 else None
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in want.items():
        found = set(filter(None, got[k].labels.split(",")))
        if label:
            assert label in found, (k, label, got[k])
        else:
            assert not found - set(licenses.PHRASES.values()) or got[k].score >= licenses.LEAST_SCORE
            assert label not in found
    assert got[0].score == 1.0


def test_a_notice_without_its_key_phrase_is_none(spark):
    text, _ = licenses.NOTICES["mit"]
    df = spark.createDataFrame([(1, text.replace("without restriction", "freely now")), (2, text)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(df).collect()} == {1: "", 2: "mit"}


def test_license_index_intersects_relative_places():
    known = licenses.templates({"b a b": "x", "a": "y"}, {})
    index = licenses.RareTokenIndex(known, {b"a": 2.0, b"b": 1.0})
    assert sorted((t, p) for t, p, _ in index.scan(b"b a b a b b a".split())) == [(0, 0), (0, 2), (1, 1), (1, 3), (1, 6)]
    with pytest.raises(ValueError):
        licenses.Template.of("z", "some words", ["other"])


def test_license_odd_rows(odd, empty):
    rows = licenses.scan(odd).collect()
    assert len(rows) == 10 and sum(r.doc_id is None for r in rows) == 2
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_base, by[1].base_labels, by[1].labels, by[1].score) == (1, "mit", "mit", 1.0)
    assert (by[2].n_words, by[2].n_base, by[2].first_word, by[2].labels, by[2].score) == (0, 0, None, "", 0.0)
    assert by[4].n_words == 30_000
    assert licenses.scan(empty).collect() == []


def test_license_ids_stay_exact(spark):
    ids = [2**53 + 1, None, -(2**62) - 1]
    assert {r.doc_id for r in licenses.scan(spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")).collect()} == set(ids)


# Spelling variants


def plain_runs(doc_id, text):
    out, run = [], ""
    for c in (text or "") + " ":
        if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
            run += c.lower() if "A" <= c <= "Z" else c
        elif run:
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out.append(run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run)
            run = ""
    return [w for w in out if len(w) >= 5]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    counts = Counter(w for i, t in docs for w in plain_runs(i, t))
    counts = {w: n for w, n in counts.items() if n >= 3}
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in counts}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-counts[x], x.encode()), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def as_set(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_agrees_with_sql(spark):
    assert same_as_sql(spark, "op12_spelling")


def test_spelling_by_brute_force_on_repetitive_words(spark):
    """Few letters, so bigrams repeat within words and prefixes tie; long chains of forms."""
    draw = np.random.Generator(np.random.PCG64(3))
    words = ["".join(draw.choice(list("abé"), int(draw.integers(4, 9)))) for _ in range(400)] + ["aaaaa" + "a" * k for k in range(9)]
    docs = [(k, " ".join(draw.choice(words, 60))) for k in range(150)] + [(900 + k, " ".join(["chain" + "s" * k] * 3 * 2**k)) for k in range(8)] + [(None, "Nameless NAMELESS nameless"), (None, None)]
    got = as_set(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == plain_variants(docs)
    assert sum(x[1] is not None for x in got) > 30 and ("chain", "chains", "chainsssssss") in {x[:3] for x in got}


def test_pivots_are_disjoint_and_of_least_frequency():
    draw = np.random.Generator(np.random.PCG64(8))
    for _ in range(300):
        w = "".join(draw.choice(list("abc"), int(draw.integers(5, 12))))
        counts = {g: int(draw.integers(1, 5)) for g in spelling.bigrams(w)}
        places = spelling.prefix(w, counts)
        order = sorted(range(len(w) - 1), key=lambda i: (counts[w[i : i + 2]], w[i : i + 2], i))
        assert set(order[:3]) <= set(places) and all(w[i : i + 2] == w[order[2] : order[2] + 2] for i in set(places) - set(order[:3]))
        a, b = spelling.pivots(w, places, counts)
        weigh = lambda x, y, w=w, counts=counts: counts[w[x : x + 2]] + counts[w[y : y + 2]]
        assert b - a >= 2 and weigh(a, b) == min(weigh(x, y) for x in places for y in places if y - x >= 2)


def test_spelling_odd_rows(odd, empty):
    assert as_set(spelling.variants(empty)) == set()
    want = plain_variants([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert as_set(spelling.variants(odd)) == want
    long = odd.sparkSession.createDataFrame([(k, "ab" * 4000 + " " + "ab" * 4000 + "a") for k in range(3)] + [(9, "b" * 3000)] * 3, "doc_id long, text string")
    assert as_set(spelling.variants(long)) == plain_variants([(r.doc_id, r.text) for r in long.collect()])


# Filter audit


def plain_audit(docs, labels):
    firsts: dict = {}
    for i, t, _ in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    rows = []
    for i, t, s in docs:
        t = t or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        fails = {f for f, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in t for c in "#$%&*|"), i is not None and i > firsts[t]), strict=True) if x}
        rows.append((s or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed = {}
        for o in permutations("ABCDE"):
            for k, f in enumerate(o):
                here = [r for r in mine if f in r[1] and not r[1] & set(o[:k])]
                removed[o, k] = len(here)
                failing = sum(f in r[1] for r in mine)
                out.append((part, "".join(o), k + 1, sum(not r[1] & set(o[: k + 1]) for r in mine), len(here), failing - len(here), sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)))
        shapley = {f: sum(n for (o, k), n in removed.items() if o[k] == f) for f in "ABCDE"}
        out = [(*r, shapley[r[1][r[2] - 1]]) if r[0] == part and len(r) == 9 else r for r in out]
    return sorted(out)


def test_audit_agrees_with_sql(spark):
    assert same_as_sql(spark, "op13_audit")


def test_audit_by_brute_force_with_odd_rows(spark, odd, empty):
    spark_labels = [(1, 1, 0), (1, 0, 1), (4, None, 1), (None, 1, 1), (6, 1, None), (77, 1, 1)]
    labels = spark.createDataFrame(spark_labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    copies = [(20 + k, f"copy {k % 3}", "s" if k % 2 else "t") for k in range(30)] + [(25, "copy 1", "u"), (8, LONG, "u"), (4, LONG, "u")]
    df = odd.select("doc_id", "text", "source").union(spark.createDataFrame(copies, "doc_id long, text string, source string")).withColumns({c: F.lit(7) for c in CLASHES})
    got = sorted(tuple(r) for r in audit.audit(df, labels).collect())
    assert got == plain_audit([(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()], spark_labels)
    assert len(got) == 600 * 5
    assert audit.audit(empty, labels).collect() == []
    assert audit.audit(df, labels.limit(0)).where("good_lost > 0 or toxic_lost > 0").isEmpty()


def test_packed_counters_do_not_run_over():
    for width in (1, 3, 40):
        most = (1 << width) - 1
        for mask in range(32):
            fields = audit.unpacked(most * audit.packed(mask, width), width)
            assert all(sum(f) == (most if mask else 0) and set(f) <= {0, most} for f in fields)
