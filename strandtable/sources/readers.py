"""Readers and writers of the formats that the operators take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import settle


def read_table(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """csv, tsv or txt (tab) with a header; strings unless ``infer``."""
    name = path.removesuffix(".gz")
    return spark.read.csv(path, sep="," if name.endswith(".csv") else "\t", header=True, inferSchema=infer)


def attribute(text: Column, key: str) -> Column:
    """``key "value";`` of a GTF attribute column; missing: ''."""
    return F.regexp_extract(text, rf'(?:^|;)\s*{key} "([^"]*)"', 1)


def read_gtf(spark: SparkSession, path: str, features: list[str] = (), biotypes: list[str] = (), chromosomes: list[str] = ()) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", comment="#", quote="", schema="chrom string, source string, feature string, start int, stop int, score string, strand string, frame string, attributes string")
    rows = raw.select("chrom", "feature", "start", "stop", "strand", *[attribute(F.col("attributes"), k).alias(k) for k in ("gene_id", "gene_name", "gene_biotype", "transcript_id", "exon_id")])
    for c, keep in (("feature", features), ("gene_biotype", biotypes), ("chrom", chromosomes)):
        rows = rows.where(F.col(c).isin(list(keep))) if keep else rows
    return rows


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Fixed columns, ``info`` as a map (flags: null) and ``samples`` as an array of (name, values map)."""
    lines = spark.read.text(path)
    header = lines.where(F.col("value").startswith("#CHROM")).first()
    names = header[0].lstrip("#").split("\t")[9:] if header else []
    p = F.split("value", "\t")
    fixed = [p[i].alias(n) for i, n in enumerate(("chrom", "pos", "id", "ref", "alt", "qual", "filter"))]
    info = F.str_to_map(p[7], F.lit(";"), F.lit("=")).alias("info")
    one = lambda i, n: F.struct(F.lit(n).alias("sample"), F.map_from_arrays(F.split(p[8], ":"), F.split(p[9 + i], ":")).alias("values"))
    samples = F.array(*[one(i, n) for i, n in enumerate(names)]).alias("samples") if names else F.lit(None).cast("array<struct<sample:string,values:map<string,string>>>").alias("samples")
    return lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(*fixed, info, samples).withColumns({"pos": F.col("pos").cast("long"), "qual": F.col("qual").try_cast("double")})


def file_headers(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """(file, position, name): the column names in the first line of each file of a folder, as they stand there."""
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"), "value").toDF("file", "part", "line", "value")
    first = lines.where("part = 0").groupBy("file").agg(F.min_by("value", "line").alias("value"))
    return first.select("file", F.posexplode(F.split("value", separator)).alias("position", "name"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, seq): records are split at lines that start with ``>``, lines are joined."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    lines = F.split("value", "\r?\n|\r$")
    return rows.select(F.split(lines[0], r"\s+")[0].alias("contig"), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "").alias("seq"))


def read_fasta_chunks(spark: SparkSession, path: str, size: int = 1 << 16) -> DataFrame:
    """(contig, chunk, offset, seq): sequences in chunks of about ``size`` letters, however long a contig or a line is.

    Files are read line by line in Spark's own ranges. A line's contig and offset are those within its range plus what
    earlier ranges of the file end with, one row a range. A chunk holds what begins between ``chunk * size`` and the
    next, so chunks follow each other without gap or overlap, and all but a contig's last are at least half as long as ``size``.
    """
    at = ["_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"), "value"]
    rows = settle(spark.read.text(path).select(*at).toDF("file", "part", "line", "value").withColumn("value", F.regexp_replace("value", "\r$", "")), "fasta-lines")
    head = F.col("value").startswith(">")
    long = F.when(head, 0).otherwise(F.length("value")).cast("long")
    inside = Window.partitionBy("file", "part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"letters": long, "name": F.when(head, F.split(F.substring("value", F.lit(2), F.length("value")), r"\s+")[0])})
    rows = rows.withColumns({"ends": F.sum("letters").over(inside), "own": F.last("name", True).over(inside)})
    rows = rows.withColumn("zero", F.last(F.when(head, F.col("ends")), True).over(inside))
    parts = rows.groupBy("file", "part").agg(F.sum("letters").alias("all"), F.max_by("own", "line").alias("last"), (F.sum("letters") - F.max("zero")).alias("tail"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("sum", F.coalesce(F.sum("all").over(before), F.lit(0)))
    # Where the last contig of the earlier ranges begins, counted from the start of the file.
    parts = parts.withColumns({"carried": F.last("last", True).over(before), "begins": F.last(F.when(F.col("last").isNotNull(), F.col("sum") + F.col("all") - F.col("tail")), True).over(before)})
    parts = parts.select(F.col("file").alias("_f"), F.col("part").alias("_p"), "sum", "carried", "begins")
    rows = rows.join(parts, (F.col("file") == F.col("_f")) & (F.col("part") == F.col("_p")))
    offset = F.col("sum") + F.col("ends") - F.col("letters") - F.when(F.col("own").isNotNull(), F.col("sum") + F.col("zero")).otherwise(F.col("begins"))
    lines = rows.where(~head & (F.col("letters") > 0)).select(F.coalesce("own", "carried").alias("contig"), offset.alias("offset"), "value").where("contig is not null")
    # Long lines are cut, so that a chunk's length does not depend on them.
    piece = max(1, size // 2)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("value") - 1) / piece).cast("int")), lambda i: F.struct((F.col("offset") + i * piece).alias("offset"), F.substring(F.col("value"), i * piece + 1, F.lit(piece)).alias("seq")))
    pieces = lines.select("contig", F.explode(cut).alias("x")).select("contig", "x.*").withColumn("chunk", F.floor(F.col("offset") / size))
    joined = F.array_sort(F.collect_list(F.struct("offset", "seq")))
    return pieces.groupBy("contig", "chunk").agg(F.min("offset").alias("offset"), F.array_join(F.transform(joined, lambda x: x["seq"]), "").alias("seq"))


def read_obo(spark: SparkSession, path: str, namespace: str | None = None) -> DataFrame:
    """(id, name, namespace, parents) of terms that are not obsolete; ``is_a`` and any relationship are parents."""
    rows = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value").startswith("[Term]"))
    lines = F.split("value", "\n")
    field = lambda k: F.regexp_extract("value", rf"(?:^|\n){k}: ([^\n]*)", 1)
    kin = F.filter(lines, lambda x: x.startswith("is_a: ") | x.startswith("relationship: "))
    parents = F.transform(kin, lambda x: F.regexp_extract(x, r"^(?:is_a: |relationship: \S+ )(\S+)", 1))
    out = rows.where(~F.col("value").contains("\nis_obsolete: true")).select(field("id").alias("id"), field("name").alias("name"), field("namespace").alias("namespace"), parents.alias("parents"))
    return out.where(F.col("namespace") == namespace) if namespace else out


def read_kraken_report(spark: SparkSession, path: str, ranks: list[str], contaminants: list[str] = ()) -> DataFrame:
    """(sample, percent, fragments, direct, rank, taxid, name) of listed ranks with fragments, without contaminants (taxid or name)."""
    p = F.split("value", "\t")
    k = F.size(p)
    at = lambda i: F.trim(F.get(p, k - i))
    rows = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/]*)?$", 1).alias("sample"), F.trim(p[0]).cast("double").alias("percent"), F.trim(p[1]).cast("long").alias("fragments"), F.trim(p[2]).cast("long").alias("direct"), at(3).alias("rank"), at(2).alias("taxid"), at(1).alias("name"), k.alias("_k")).where("_k in (6, 8)").drop("_k")
    rows = rows.where(F.col("rank").isin(ranks) & (F.col("fragments") > 0))
    return rows.where(~F.col("taxid").isin(list(contaminants)) & ~F.col("name").isin(list(contaminants))) if contaminants else rows


def read_taxdump(spark: SparkSession, names: str, nodes: str) -> tuple[DataFrame, DataFrame]:
    """(taxid, name) by the first name of each, and (child, parent, rank)."""
    split = lambda path: spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("p"))
    n, d = split(names), split(nodes)
    first = n.groupBy(F.col("p")[0].cast("long").alias("taxid")).agg(F.min_by(F.col("p")[1], "line").alias("name"))
    return first, d.select(F.col("p")[0].cast("long").alias("child"), F.col("p")[1].cast("long").alias("parent"), F.col("p")[2].alias("rank"))


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, start int, stop int, coverage double")


def read_methylation_cov(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, start int, stop int, percentage double, meth int, unmeth int")


def read_comparison_design(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """Key and value lines, then a table whose header starts with ``sample`` or ``file_path``. Only the lines up to the header reach the driver."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("_line"), F.split("value", "\t").alias("_x"))
    at = lines.where(F.lower(F.col("_x")[0]).isin("sample", "file_path")).orderBy("_line").first()
    before = lines.where(F.col("_line") < at["_line"]) if at else lines
    head = {r["_x"][0]: "\t".join(r["_x"][1:]) for r in before.orderBy("_line").collect()}
    columns = [c.strip() for c in at["_x"]] if at else ["sample", "condition"]
    rows = lines.where(F.col("_line") > at["_line"]) if at else lines.where("false")
    return head, rows.select(*[F.get("_x", F.lit(k)).alias(c) for k, c in enumerate(columns)])


def merge_sample_files(spark: SparkSession, paths: list[str] | str, ids: int = 1, column: int = 1, skip: int = 0, how: str = "outer", sep: str = "\t") -> DataFrame:
    """(feature, sample, value) of many one-sample files; the sample is the file's name.

    ``outer`` leaves missing cells out (they are zero); ``inner`` keeps features that all files have. ``skip``
    drops first lines of each file.
    """
    p = F.split("value", sep)
    rows = spark.read.text(paths).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/]*)?$", 1).alias("sample"), F.monotonically_increasing_id().alias("_line"), "value")
    if skip:
        first = rows.groupBy("sample").agg(F.array_sort(F.collect_list(F.when(F.col("_line") % (1 << 33) < skip, F.col("_line")))).alias("_f")).select("sample", F.slice("_f", 1, skip).alias("_f"))
        rows = rows.join(F.broadcast(first), "sample").where(~F.array_contains("_f", F.col("_line"))).drop("_f")
    feature = F.array_join(F.slice(p, 1, ids), "|") if ids > 1 else p[0]
    out = rows.select(feature.alias("feature"), "sample", F.get(p, F.lit(column)).try_cast("double").alias("value")).where("value is not null")
    if how == "inner":
        n = out.select("sample").distinct().count()
        good = out.groupBy("feature").agg(F.countDistinct("sample").alias("n")).where(F.col("n") == n)
        out = out.join(good.select("feature"), "feature", "left_semi")
    return out.groupBy("feature", "sample").agg(F.sum("value").alias("value"))


def write_table(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.csv(path, sep="\t", header=True, compression="gzip" if compress else "none")


def write_fasta_per_contig(seqs: DataFrame, path: str, width: int = 80) -> None:
    """A folder for each contig, lines of ``width`` letters."""
    body = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    rows = seqs.select("contig", F.concat(F.lit(">"), "contig", F.lit("\n"), body).alias("value"))
    rows.write.partitionBy("contig").text(path)


def parse_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set, gene) of files with a ``STANDARD_NAME`` and a ``GENE_SYMBOLS`` line (comma separated)."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), p[0].alias("key"), F.get(p, F.lit(1)).alias("text"))
    names = rows.where("key = 'STANDARD_NAME'").groupBy("file").agg(F.min("text").alias("set"))
    genes = rows.where("key = 'GENE_SYMBOLS'").select("file", F.explode(F.split("text", ",")).alias("gene")).where("gene <> ''")
    return genes.join(names, "file").select("set", "gene").distinct()


def as_gtf_line(columns: dict[str, Column], attributes: dict[str, Column]) -> Column:
    """A GTF line from columns."""
    text = reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.concat(F.lit(f'{k} "'), v, F.lit('";')) for k, v in attributes.items()])
    c = columns
    return F.concat_ws("\t", c["chrom"], F.lit("made"), c["feature"], c["start"].cast("string"), c["stop"].cast("string"), F.lit("."), c["strand"], F.lit("."), text)
