"""FASTA files in chunks against the sequences themselves."""

import random

import pytest
from pyspark.sql import functions as F

from strandtable.operators import sequences
from strandtable.sources import readers


@pytest.fixture(scope="module")
def fasta(tmp_path_factory):
    """Contigs over many file ranges: lines of 70, one line of 1.5 MB, empty and tiny ones; and a file with carriage returns."""
    draw = random.Random(1)
    seqs = {"long": 3_000_000, "line": 1_500_000, "none": 0, "tiny": 5, "odd": 1001}
    seqs = {k: "".join(draw.choices("ACGTN", k=n)) for k, n in seqs.items()}
    folder = tmp_path_factory.mktemp("fasta")
    wrap = lambda s, end, w=70: "".join(s[i : i + w] + end for i in range(0, len(s), w))
    (folder / "a.fa").write_text("stray\n>long first contig\n" + wrap(seqs["long"], "\n") + ">line\n" + seqs["line"] + "\n>none\n>tiny\n" + seqs["tiny"] + "\n")
    (folder / "b.fa").write_bytes((">odd x>y\r\n" + wrap(seqs["odd"], "\r\n", 33)).encode())
    return str(folder), seqs


def test_chunks_make_the_contigs(spark, fasta):
    folder, seqs = fasta
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        chunks = readers.read_fasta_chunks(spark, folder, 20_000)
        assert chunks.count() > 200
        rows = chunks.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by = {}
    for r in sorted(rows, key=lambda r: (r.contig, r.offset)):
        assert r.offset == len(by.get(r.contig, "")) and r.offset // 20_000 == r.chunk
        by[r.contig] = by.get(r.contig, "") + r.seq
    assert by == {k: s for k, s in seqs.items() if s}
    last = {r.contig: max(x.chunk for x in rows if x.contig == r.contig) for r in rows}
    assert all(len(r.seq) >= 10_000 for r in rows if r.chunk < last[r.contig]) and max(len(r.seq) for r in rows) < 30_100


def test_kmers_over_borders_are_those_of_whole_contigs(spark, fasta):
    folder, seqs = fasta
    small = spark.createDataFrame([(k, s[:40_000]) for k, s in seqs.items()], "contig string, seq string")
    cut = small.select("contig", F.explode(F.expr("sequence(0, greatest(cast((length(seq) - 1) / 500 as int), 0))")).alias("chunk"), "seq")
    cut = cut.select("contig", "chunk", (F.col("chunk") * 500).cast("long").alias("offset"), F.substring("seq", F.col("chunk") * 500 + 1, F.lit(500)).alias("seq"))
    for k in (1, 31):
        whole, got = sequences.kmers(small, k), sequences.chunk_kmers(cut, k)
        assert whole.count() == got.count() and whole.exceptAll(got.select("contig", F.col("pos").cast("int"), "kmer")).isEmpty()
    assert sequences.distinct_kmers(cut, 5).count() == sequences.distinct_kmers(small, 5).count()


def test_promoters_from_chunks(spark, fasta):
    folder, seqs = fasta
    chunks = readers.read_fasta_chunks(spark, folder, 1000)
    draw = random.Random(2)
    genes = [(i, draw.choice(["long", "line", "odd", "tiny", "absent"]), draw.choice("+-"), s := draw.randrange(0, 900), s + draw.randrange(10, 2000)) for i in range(300)]
    df = spark.createDataFrame(genes, "gene int, chrom string, strand string, start int, stop int")
    whole = spark.createDataFrame(list(seqs.items()), "contig string, seq string")
    want = {(r.gene, r.promoter) for r in sequences.promoter_windows(df, whole, 700, 2500).collect() if r.promoter}
    got = {(r.gene, r.promoter) for r in sequences.promoter_windows_in_chunks(df, chunks, 700, 2500, 1000).collect() if r.promoter}
    assert got == want and len(got) > 150
