"""Sources and conversions that depend on the order of lines, also where splits are smaller than records."""

import random

import pytest
from pyspark.sql import functions as F

from gapweave.plans import convert
from gapweave.sources import fasta, text
from tests.test_engine import frame, pairs


@pytest.fixture(params=["128m", "64b"])
def splits(spark, request):
    """Splits of a whole file, and of a line or so."""
    keys = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def records(seed, n):
    rng = random.Random(seed)
    return [(f"c{i}", "".join(rng.choice("acgtN") for _ in range(rng.choice([0, 1, 30, 61, 200])))) for i in range(n)]


def written(path, recs, width=17):
    path.write_text("".join(f">{name} text > more\n" + "".join(seq[i : i + width] + "\n" for i in range(0, len(seq), width)) for name, seq in recs))
    return str(path)


def test_records_over_splits(spark, tmp_path, monkeypatch, splits):
    monkeypatch.setattr(fasta, "CHUNK", 32)
    a, b = records(1, 6), records(2, 3)
    written(tmp_path / "a.fasta", a)
    written(tmp_path / "b.fa", b)
    parts = fasta.chunks(spark, str(tmp_path))
    want = sorted((s, i, name, seq.upper()) for s, recs in (("a", a), ("b", b)) for i, (name, seq) in enumerate(recs))
    assert pairs(text.fasta(spark, str(tmp_path)), "sample", "contig_idx", "contig", "sequence") == want
    assert pairs(fasta.contigs(parts), "sample", "contig_idx", "contig", "length") == [(s, i, c, len(q)) for s, i, c, q in want]
    whole = "".join(seq for _, seq in a).upper()
    mine = fasta.chunks(spark, str(tmp_path / "a.fasta"))
    assert pairs(fasta.base_rows(mine), "pos", "base") == list(enumerate(whole))
    assert pairs(fasta.masked_positions(mine), "pos") == [(i,) for i, x in enumerate(whole) if x == "N"]


def test_export(spark, tmp_path, monkeypatch, splits):
    monkeypatch.setattr(fasta, "CHUNK", 32)
    a = records(3, 7)
    parts = fasta.chunks(spark, written(tmp_path / "a.fasta", a), upper=False)
    want = [">ref"] + [seq[i : i + 60] for _, seq in a for i in range(0, len(seq), 60)]
    got = fasta.lines(parts, "ref").orderBy("contig_idx", "line").collect()
    assert [r.value for r in got] == want
    assert fasta.index(parts, "ref").first().value == f"ref\t{sum(len(s) for _, s in a)}\t5\t60\t61"
    out = str(tmp_path / "out")
    fasta.write(parts, "ref", out)
    again = text.fasta(spark, written(tmp_path / "b.fasta", a), upper=False)
    assert again.count() == 7
    read = fasta.chunks(spark, out, upper=False, joined=True)
    joined = "".join(r.bases for r in read.orderBy("at").collect())
    assert joined == "".join(seq for _, seq in a)
    assert pairs(fasta.contigs(read), "contig", "length") == [("ref", len(joined))]


def test_no_records(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text("ACGT\n\n")
    assert fasta.chunks(spark, str(p)).count() == 0
    assert text.fasta(spark, str(p)).count() == 0


def test_alignment_to_core(spark, tmp_path, monkeypatch, splits):
    monkeypatch.setattr(convert, "BLOCK", 7)
    rng = random.Random(5)
    n = 50
    places = [(f"chr{i % 2}", 10 + 3 * i) for i in range(n)]
    listed = [f"{c}\t{p}\t1\ts" for c, p in places]
    listed[20:20] = ["short", "chr0\t0\t1", "chr0\tx\t1"]
    (tmp_path / "list.txt").write_text("\n".join(listed) + "\n")
    ref = "".join(rng.choice("ACGT") for _ in range(n))
    samples = {s: "".join(rng.choice("ACGTN-a") for _ in range(n)) for s in ("s1 x", "s2")}
    r, a = written(tmp_path / "ref.fa", [("r1", ref[:20]), ("r2", ref[20:])]), tmp_path / "a.fa"
    a.write_text("".join(f">{s}\n{q[:23]}\n{q[23:]}\n" for s, q in samples.items()))
    got = pairs(convert.convert(spark, "alignment", "core", str(tmp_path / "list.txt"), r, str(a)), "sample", "chrom", "pos", "ref", "allele")
    assert got == sorted((s, c, p - 1, ref[i], q[i]) for s, q in samples.items() for i, (c, p) in enumerate(places))
    a.write_text(f">s1\n{ref}\n>s2\n{ref[:-1]}\n")
    with pytest.raises(ValueError, match="s2 has 49 alleles, the list 50"):
        convert.alignment_to_core(spark, str(tmp_path / "list.txt"), r, str(a))
    with pytest.raises(ValueError, match="the reference has 49"):
        convert.alignment_to_core(spark, str(tmp_path / "list.txt"), written(tmp_path / "r.fa", [("r", ref[:-1])]), str(a))


def test_alignment_to_core_of_folders(spark, tmp_path):
    """Sources written by Spark are folders of several files: neither the list nor a record ends with a file."""
    texts = {"list": ["c\t5", "c\t6", "c\t7", "c\t8"], "ref": [">r", "AC", "G", "T"], "a": [">s1", "AA", "C", "G", ">s2", "T", "TTT"]}
    for name, rows in texts.items():
        (tmp_path / name).mkdir()
        for i in range(0, len(rows), 2):
            (tmp_path / name / f"part-{i:05d}").write_text("\n".join(rows[i : i + 2]) + "\n")
    got = pairs(convert.alignment_to_core(spark, *[str(tmp_path / x) for x in texts]), "sample", "pos", "ref", "allele")
    assert got == sorted((s, 4 + i, "ACGT"[i], q[i]) for s, q in (("s1", "AACG"), ("s2", "TTTT")) for i in range(4))


NEXUS = "#nexus\nbegin data;\ntaxlabels\tREF\ts1\ts2\ts3;\n1\tA\tC\tG\tT\nmatrix\n1\tA\tC\tG\tc\n\n2\tA\tC\tT\tCT\n3\tA\tN\tG\tG\nx\ty\n;\nend;\nbegin trees;\n9\tA\tC\tG\tT\nend;\n"


def test_nexus(spark, tmp_path, splits):
    p = tmp_path / "x.nex"
    p.write_text(NEXUS)
    got = pairs(convert.convert(spark, "nexus", "distances", str(p)), "a", "b", "distance")
    assert got == [("s1", "s2", 2), ("s1", "s3", 0), ("s2", "s3", 1)]
    p.write_text("taxlabels\ts1;\n")
    with pytest.raises(ValueError, match="no matrix"):
        convert.nexus_to_distances(spark, str(p))


def test_genotypes_and_dispatch(spark, tmp_path):
    p = tmp_path / "t.table"
    p.write_text("CHROM\tPOS\tREF\tALT\tTYPE\ts1.GT\ts2.GT.GT\nc\t5\tA\tG\tSNP\tG/G\t.|.\nc\t6\tA\tG\tSNP\tA|G\t./A\nc\tx\tA\tG\tSNP\tA\tA\nshort\n")
    got = pairs(convert.convert(spark, "genotypes", "core", str(p)), "pos", "sample", "allele")
    assert got == [(4, "s1", "G"), (4, "s2", "N"), (5, "s1", "A"), (5, "s2", "N")]
    with pytest.raises(ValueError, match="no conversion"):
        convert.convert(spark, "x", "y")
    p.write_text("a\tb\n")
    with pytest.raises(ValueError, match="TYPE"):
        convert.genotypes_to_core(spark, str(p))


def test_aligned_folders(spark, tmp_path):
    """The first folder by priority counts, even where another holds a file of a better name."""
    for folder, name, seq in (("s1_snippy_Xref", "snps.aligned.fa", "NNA"), ("s1_snippy", "s1_snippy.aligned.fa", "ANA"), ("s2_snippy", "s2.aligned.fa", "AAN"), ("s2_snippy", "snps.aligned.fa", "NNN"), ("s2", "s2_snippy.aligned.fa", "NNN"), ("s3", "other.txt", "NNN"), ("s4", "s4.aligned.fa", "nAn")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(f">x\n{seq[:2]}\n>y\n{seq[2:]}\n")
    s = frame(spark, [(f"s{i}",) for i in range(1, 6)], "sample string")
    found = fasta.aligned_files(spark, str(tmp_path), s, "X")
    assert [(a, b.split("/")[-2:]) for a, b in pairs(found, "sample", "path")] == [("s1", ["s1_snippy_Xref", "snps.aligned.fa"]), ("s2", ["s2_snippy", "s2.aligned.fa"]), ("s4", ["s4", "s4.aligned.fa"])]
    assert pairs(fasta.aligned_gaps(spark, found), "sample", "start", "end") == [("s1", 1, 3), ("s2", 3, 4), ("s4", 1, 2), ("s4", 3, 4)]
    plain = fasta.aligned_files(spark, str(tmp_path), s)
    assert pairs(plain, "sample", "path")[0][1].endswith("s1_snippy/s1_snippy.aligned.fa")
    assert fasta.aligned_gaps(spark, plain.limit(0)).count() == 0


def test_folders(spark, tmp_path):
    """Sequence files by their endings, matrices and references by name, alignments by how far they are processed."""
    import gzip

    for name in ("a.fa", "b.fasta", "c.fna", "note.txt", "x.fa.bak"):
        (tmp_path / name).write_text(f">{name}\nAC\n")
    with gzip.open(tmp_path / "d.fa.gz", "wt") as f:
        f.write(">d\nACG\n")
    got = pairs(fasta.contigs(fasta.folder(spark, str(tmp_path))), "sample", "length")
    assert got == [("a", 2), ("b", 2), ("c", 2), ("d", 3)]
    assert text.find_matrix(spark, str(tmp_path), "snippy") is None
    (tmp_path / "hamming_distances_filtered.tsv").write_text("\ta_snippy\tb\na_snippy\t0\t2\nb\t2\t0\n")
    (tmp_path / "core.dist.tsv").write_text("\tz\nz\t9\n")
    assert pairs(text.find_matrix(spark, str(tmp_path), "snippy"), "row", "col", "distance") == [("a", "a", 0), ("a", "b", 2), ("b", "a", 2), ("b", "b", 0)]
    (tmp_path / "r.json").write_text("{}")
    assert text.report_reference(spark, str(tmp_path / "r.json")) is None
    (tmp_path / "ref.fa").write_text(">r\nACGT\n")
    (tmp_path / "reference.fasta").write_text(">r\nACGTA\n")
    assert fasta.contigs(text.report_reference(spark, str(tmp_path / "r.json"))).first().length == 5
    for folder, name in (("s1", "reads.bam"), ("s1", "reads.sorted.bam"), ("s1", "reads.unsorted.bam"), ("deep/s2", "x.sorted.deduped.bam"), ("deep/s2", "x.indelrealigned.bam"), ("s3", "b.bam"), ("s3", "a.bam")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text("x")
    assert [(s, p.split("/")[-1]) for s, p in pairs(text.alignment_files(spark, str(tmp_path)), "sample", "path")] == [("s1", "reads.sorted.bam"), ("s2", "x.indelrealigned.bam"), ("s3", "a.bam")]


@pytest.mark.parametrize("read", [text.paf, text.sam, text.gff, text.vcf_calls, lambda spark, rows: text.viewer_snps(spark, rows, "cfsan")])
def test_lines_are_split_once(spark, read):
    """The optimizer copies no split into the filters and cells that read it."""
    line = spark.range(10).selectExpr("'f' AS file", "id AS n", "concat_ws('\t', id, repeat('1\t', 12)) AS line")
    plan = read(spark, line)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(line") + plan.count("split(concat_ws") == 1
