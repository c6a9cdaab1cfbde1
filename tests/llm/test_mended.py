"""Cases that earlier versions of the text operators got wrong."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from strandtable.llm import minhash, pii, similar, simhash, warc


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.surrogates(df, "k").orderBy("doc_id").collect()]


def test_one_secret_in_two_casings(spark):
    got = replaced(spark, ['key = "DeadBeefDeadBeefDeadBeefDeadBeef"', 'key = "deadbeefdeadbeefdeadbeefdeadbeef"'])
    assert got[0].lower() == got[1].lower() and "deadbeef" not in got[0].lower()


def test_letters_beyond_the_common_ones_move(spark):
    texts = ["Mr Łukasz Őő", "Mr Őry", "Mr Ğışık", "Mr Țăranu", "Mr İnan", "Herr Ąę Żółć", "Mr Nguyễn"]
    for before, after in zip(texts, replaced(spark, texts), strict=True):
        assert len(before) == len(after) and before.split()[0] == after.split()[0]
        for a, b in zip(before.split()[1:], after.split()[1:], strict=True):
            assert a[0] != b[0] and b[0].isupper() and b[1:].islower(), (before, after)


def test_names_of_one_ending_meet_listed_names_without_a_clash(spark):
    """Every given name of the pattern of Mark, and listed names themselves: as many surrogates as names, all other ones."""
    names = [f"{a}{v}{b}k" for a in "BCDFGHJKLMNPQRSTVWXYZ" for v in "aeiou" for b in "bcdfghjklmnpqrstvwxyz"]
    texts = [f"Mr {n} Smith" for n in [*names, *pii.MALE_NAMES[0]]]
    texts = list(dict.fromkeys(texts))
    got = replaced(spark, texts)
    assert len(set(got)) == len(texts) and not any(a == b for a, b in zip(texts, got, strict=True))


def test_many_entities_of_all_kinds_stay_distinct_and_coreferent(spark):
    """100,000 entities, each in two ways to write it: as many surrogates as entities, and both ways get one."""
    draw = random.Random(4)
    word = lambda n, letters=string.ascii_lowercase: "".join(draw.choices(letters, k=n))
    make = {
        "email": lambda: (m := f"{word(4)}.{word(3)}@{word(4)}.com", m.upper()),
        "name": lambda: (m := f"Mr {word(5).title()}", m.upper().replace("MR ", "MR ")),
        "ip": lambda: (m := ".".join(str(draw.randrange(256)) for _ in range(4)), m),
        "phone": lambda: (f"+1 (555) {(d := word(7, string.digits))[:3]}-{d[3:]}", f"+1 555 {d[:3]} {d[3:]}"),
        "secret": lambda: (m := word(32, "0123456789abcdef"), m.upper()),
        "ssn": lambda: (m := f"{word(3, string.digits)}-{word(2, string.digits)}-{word(4, string.digits)}", m),
    }
    plain = {"email": str.lower, "name": str.lower, "ip": str, "ssn": str, "secret": str.lower, "phone": lambda x: re.sub(r"\D", "", x)}
    rows = {}
    while len(rows) < 100_000:
        kind = draw.choice(list(make))
        one, two = make[kind]()
        rows[kind, plain[kind](one)] = (one, two)
    quote = lambda kind, x: f'"{x}"' if kind == "secret" else f"<{x}>"
    df = spark.createDataFrame([(i, f"{quote(k, a)} {quote(k, b)}") for i, ((k, _), (a, b)) in enumerate(rows.items())], "doc_id long, text string").repartition(16)
    got = {r.doc_id: r for r in pii.surrogates(df, "k").collect()}
    seen = {}
    for i, ((kind, entity), (one, two)) in enumerate(rows.items()):
        new = re.findall(r"[\"<]([^\">]*)[\">]", got[i].text)
        assert got[i].n_entities == 2 and len({plain[kind](x) for x in new}) == 1, (kind, one, two, got[i])
        assert new[0] != one and seen.setdefault((kind, plain[kind](new[0])), entity) == entity


def test_clashes_are_listed(spark):
    found = spark.createDataFrame([("ip", "1.1.1.1", "2.2.2.2"), ("ip", "1.1.1.1", "3.3.3.3"), ("ip", "4.4.4.4", "5.5.5.5"), ("name", "A", "B"), ("name", "C", "b")], "kind string, mention string, new string")
    assert sorted(map(tuple, pii.clashes(found).collect())) == [("ip", "1.1.1.1", "2.2.2.2"), ("ip", "1.1.1.1", "3.3.3.3"), ("name", "a", "b"), ("name", "c", "b")]


def test_urls_come_back_whole(spark):
    urls = ["http://a/\u0085b", "http://a/ b ", "", None, "http://a/\u000bx", "a WARC-Type: revisit"]
    df = spark.createDataFrame([(i, u, f"p{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read(spark, warc.write(df)).collect()}
    assert [got[i].url for i in range(len(urls))] == urls and {r.record_type for r in got.values()} == {"response"}


A, B, C = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")


@pytest.mark.parametrize("near", [False, True])
def test_classes_are_of_texts_not_of_ids(spark, near):
    """One doc_id with two unlike texts does not join the classes of either."""
    rows = [(5, A), (5, B), (9, A), (12, B), (20, C), (21, C + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    if near:
        got = sorted((r.doc_id, r.component_id) for r in simhash.similar_classes(df).collect())
        assert got == [(5, 5), (5, 5), (9, 5), (12, 5), (20, 20), (21, 20)]
        return
    found = minhash.near_duplicates(df)
    got = sorted((r.doc_id, bytes(r.text_id), r.class_id, r.n_links) for r in found.collect())
    assert [(i, c, n) for i, _, c, n in got] == [(5, 5, 0), (5, 5, 0), (9, 5, 0), (12, 5, 0), (20, 20, 1), (21, 20, 1)]


def test_near_copies_of_one_id_with_several_texts(spark):
    """The near copies of either text of a repeated id are found, and texts linked to one of them are not linked to the other."""
    rows = [(5, A), (5, B), (9, A + " x"), (12, B + " y"), (30, A + " z"), (40, C)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = {(r.doc_id, bytes(r.text_id)): (r.class_id, r.n_links) for r in minhash.near_duplicates(df).collect()}
    assert all(n > 0 for (i, _), (_, n) in links.items() if i != 40) and links[next(k for k in links if k[0] == 40)] == (40, 0)


def shuffled_bytes(spark):
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("near_duplicates", [minhash.near_duplicates, simhash.similar_classes])
def test_texts_without_candidates_are_not_shuffled(spark, tmp_path, near_duplicates):
    """Of 400 texts two are near copies: the search shuffles those, its keys and signatures, but not all texts."""
    draw = random.Random(6)
    texts = [" ".join(f"{draw.getrandbits(64):x}" for _ in range(2000)) for _ in range(399)]
    texts.append(texts[0] + " more")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs, before = spark.read.parquet(str(tmp_path / "docs")).withColumn("node", F.col("doc_id")), shuffled_bytes(spark)
    found = near_duplicates(docs).collect()
    assert {r.doc_id: r["class_id" if "class_id" in r else "component_id"] for r in found} == {i: i if i < 399 else 0 for i in range(400)}
    assert shuffled_bytes(spark) - before < sum(map(len, texts)) / 10


def test_filter_of_a_join_loses_no_row(spark):
    """With room for the bits few other rows pass; with too few bits more do; the ids' own rows always do."""
    rows = spark.range(-1000, 100_000).withColumnRenamed("id", "doc_id")
    ids = rows.where("doc_id % 7 = 0").select(F.col("doc_id").alias("x"))
    want, most = {r.x for r in ids.collect()}, rows.count()
    for bits, others in ((similar.MOST_BITS, 0.01), (1 << 17, 0.2), (1 << 10, 1)):
        got = [r.doc_id for r in similar.perhaps_among(rows, "doc_id", ids.union(ids), bits).collect()]
        assert len(set(got)) == len(got) and want <= set(got) and len(got) - len(want) <= others * most
    assert similar.perhaps_among(rows, "doc_id", ids.limit(0)).count() == 0
