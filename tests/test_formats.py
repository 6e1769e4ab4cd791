"""Reports, data sources, pileup text, long alignments, sorted pages and small helpers."""

import json
import random
import re
import subprocess
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gapweave.operators import alignments, callsets, qc, viewer
from gapweave.plans import convert
from gapweave.sources import config, datasource, report, sinks
from tests.test_engine import frame, pairs


def plain_bases(bases, ref):
    """The read bases of an mpileup column, character by character."""
    out, i = [], 0
    while i < len(bases):
        c = bases[i]
        if c in ".,":
            out.append(ref.upper())
        elif c == "^":
            i += 1
        elif c in "+-":
            number = re.match("[0-9]*", bases[i + 1 :]).group()
            i += len(number) + int(number or 0) + 1
        elif c.upper() in "ACGT":
            out.append(c.upper())
        i += 1
    return "".join(out)


def test_pileup_text(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("..,,ACgt^^++--123$*N") for _ in range(rng.randrange(30)))) for i in range(2000)]
    rows += [(2000, "," * 3000 + "+12" + "A" * 13 + "C"), (2001, ""), (2002, "^+^-.+"), (2003, None)]
    df = frame(spark, rows, "i long, bases string")
    want = {i: None if b is None else plain_bases(b, "t") for i, b in rows}
    got = df.select("i", alignments.decoded(F.col("bases"), F.lit("t")).alias("d"), alignments.read_base_counts(F.col("bases"), F.lit("t")).alias("c"))
    for r in got.collect():
        assert r.d == want[r.i]
        assert r.c is None or tuple(r.c) == tuple(want[r.i].count(b) for b in "ACGT")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_long_cigars(spark):
    rng = random.Random(3)
    rows = []
    for i, n in enumerate((1, 127, 128, 129, 1000)):
        ops = [(rng.randrange(1, 9), rng.choice("MIDNSHP=X")) for _ in range(n)]
        rows.append((i, 11 + i, "".join(f"{k}{o}" for k, o in ops), ops))
    want = []
    for i, pos, _, ops in rows:
        r, q = pos - 1, 0
        for k, o in ops:
            if o in "M=X":
                want.append((i, r, q, k))
            r += k * (o in "M=XDN")
            q += k * (o in "M=XIS")
    df = frame(spark, [(i, p, c) for i, p, c, _ in rows] + [(9, 1, "*")], "i long, pos long, cigar string")
    assert pairs(alignments.blocks(df), "i", "r", "q", "len") == sorted(want)


DOC = {
    "version": "2.0",
    "reference": {"name": "r", "label": None, "sequence": "ACGTACGTAC", "length": 10},
    "samples": {"s2": {"label": "Two"}, "s1": {}},
    "pipelines": {"z": {"label": "Z", "has_vcf": True}, "m": {"reference": True, "command": "x"}, "a": {}},
    "data": {
        "s1": {"m": {"gaps": [[3, 5], [1, 2]], "snps": [{"pos": 5, "ref": "A", "alt": "GT", "qual": 9.5, "depth": 3}, {"pos": 2, "ref": "C", "alt": "", "qual": 1.0, "depth": 1}], "vcf_path": "a.vcf"}, "z": {"gaps": [], "snps": []}},
        "s2": {"z": {"gaps": [[7, 8]], "snps": [{"pos": 5, "ref": "A", "alt": "T"}, {"pos": 5, "ref": "A", "alt": "G"}]}},
    },
    "summary": {"generated_at": "now", "warnings": ["one", "two"]},
    "kpis": {"more": [1, 2]},
}


def test_report_document(spark, tmp_path):
    p = tmp_path / "report.json"
    p.write_text(json.dumps(DOC, indent=1))
    x = report.document(spark, str(p))
    assert (x.truth_id, x.ref_len) == ("m", 10)
    assert [tuple(r) for r in x.pipelines.orderBy("place").select("pipeline", "label", "reference", "has_vcf").collect()] == [("m", None, True, None), ("a", None, False, None), ("z", "Z", False, True)]
    assert pairs(x.samples, "sample", "label") == [("s1", None), ("s2", "Two")]
    assert [tuple(r) for r in x.sorted_calls().select("sample", "pipeline", "pos", "alt", "dp").collect()] == [("s1", "m", 1, "N", 1), ("s1", "m", 4, "G", 3), ("s2", "z", 4, "T", None), ("s2", "z", 4, "G", None)]
    assert pairs(x.gaps, "sample", "pipeline", "start", "end") == [("s1", "m", 1, 2), ("s1", "m", 3, 5), ("s2", "z", 7, 8)]
    assert pairs(x.ref_base, "pos", "base") == list(enumerate("ACGTACGTAC"))
    assert pairs(x.warnings, "text") == [("one",), ("two",)]
    assert pairs(x.files, "sample", "pipeline", "vcf_path") == [("s1", "m", "a.vcf"), ("s1", "z", None), ("s2", "z", None)]
    p.write_text(json.dumps({"reference": {"sequence": "AC"}, "pipelines": {}}))
    y = report.document(spark, str(p))
    assert (y.truth_id, y.ref_len, y.calls.count(), y.samples.count()) == (None, 2, 0, 0)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_byte_ranges(tmp_path, size):
    """Each line comes once, whatever the ranges, also long ones and a last one without an end."""
    rng = random.Random(size)
    lines = ["x" * rng.choice([0, 1, 5, 40]) + str(i) for i in range(200)]
    for end in ("", "\n"):
        p = tmp_path / "t.txt"
        p.write_text("\n".join(lines) + end)
        n = p.stat().st_size
        got = [x for at in range(0, n, size) for x in datasource.lines_in(str(p), at, min(at + size, n))]
        assert got == lines
    p.write_bytes(b"a\r\nb\r\n")
    assert list(datasource.lines_in(str(p), 0, 6)) == ["a", "b"]


def test_data_sources(spark, tmp_path):
    datasource.register(spark)
    p = tmp_path / "core.tsv"
    p.write_text("CHR\tPOS\tREF\ts1_snippy_snippy\ts2\n" + "".join(f"c\t{i}\tA\tG\t-\n" for i in (5, 0, 6, 7)) + "c\tx\tA\tG\tG\nc\t9\tA\nc\t10\tA\tT\n")
    rows = spark.read.format("core_alleles").option("bytes", 9).load(str(p))
    assert pairs(rows, "pos", "sample", "allele") == [(4, "s1", "G"), (4, "s2", "-"), (5, "s1", "G"), (5, "s2", "-"), (6, "s1", "G"), (6, "s2", "-"), (9, "s1", "T")]
    some = rows.where("pos > 4 AND pos <= 6 AND sample = 's1'")
    assert pairs(some, "pos") == [(5,), (6,)]
    assert pairs(rows.where("pos = 9"), "allele") == [("T",)]
    kept = re.findall(r"Filter (.*)", some._jdf.queryExecution().executedPlan().toString())
    assert not any(re.search(r"pos#\d+L? [<>=]", k) for k in kept)  # Spark leaves bounds of positions to the source
    d = tmp_path / "depth"
    d.mkdir()
    (d / "b.txt").write_text("c\t3\t9\nc\tx\t9\n")
    (d / "a.txt").write_text("c\t1\t7\nc\t2\t0\n")
    (d / "_skip").write_text("c\t8\t8\n")
    assert pairs(spark.read.format("depth_text").load(str(d)), "pos", "depth") == [(1, 7), (2, 0), (3, 9)]
    with pytest.raises(Exception, match="CHR header"):
        spark.read.format("core_alleles").load(str(d / "b.txt")).collect()


def test_data_sources_go_by_value(spark):
    """A worker that can't import the package makes the sources from what Spark sends it."""
    datasource.register(spark)
    sent = cloudpickle.dumps(list(datasource.FORMATS.values()))
    code = "import pickle, sys; print([x.name() for x in pickle.load(sys.stdin.buffer)], 'gapweave' in sys.modules)"
    got = subprocess.run([sys.executable, "-I", "-c", code], input=sent, capture_output=True, cwd="/", timeout=120)
    assert got.stdout.decode().strip() == "['core_alleles', 'depth_text'] False", got.stderr.decode()


def test_content_duplicates(spark, monkeypatch):
    monkeypatch.setattr(qc, "PIECE", 4)
    whole = frame(spark, [("b", 0, "acgtacgtac"), ("b", 1, "TT"), ("a", 0, "TT"), ("a", 1, "ACGTACGTAC"), ("c", 0, "ACGTACGTACTT"), ("d", 0, ""), ("e", 0, "TT"), ("e", 1, "TT"), ("e", 2, "ACGTACGTAC")], "sample string, contig_idx int, sequence string")
    keep = {r.sample: (r.digest, r.keep) for r in qc.content_duplicates(whole).collect()}
    assert keep["a"][0] == keep["b"][0] and (keep["a"][1], keep["b"][1]) == (True, False)
    assert len({keep[s][0] for s in "acde"}) == 4
    chunks = frame(spark, [("b", 0, 0, "acg"), ("b", 0, 3, "tacgt"), ("b", 0, 8, "ac"), ("b", 1, 0, "TT")], "sample string, contig_idx int, at long, bases string")
    assert pairs(qc.content_duplicates(chunks), "digest") == [(keep["b"][0],)]


def test_pages(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1.0, 2.0, 3.0]), f"n{rng.randrange(50)}") for i in range(500)]
    df = frame(spark, rows, "id long, q double, name string").repartition(7)
    order = [("q", False), ("name", True), ("id", True)]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    got = sorted(callsets.pages(df, order, 60).collect(), key=lambda r: r.place)
    assert [(r.id, r.place, r.page) for r in got] == [(x[0], i, i // 60) for i, x in enumerate(want)]
    known = [r for r in want if r[1] is not None]
    last, seen = None, []
    while True:
        part = callsets.after(df.where("q IS NOT NULL"), order, 130, last).collect()
        if not part:
            break
        seen += [r.id for r in part]
        last = part[-1].asDict()
    assert seen == [r[0] for r in known]
    with pytest.raises(ValueError, match="positive"):
        callsets.pages(df, order, 0)


def test_bed_sets_without_rows(spark):
    none = frame(spark, [], "sample string, start long, end long")
    some = frame(spark, [("s", 3, 5)], "sample string, start long, end long")
    rows = sinks.bed_sets("", none, {"cfsan": some}, snp_only=some, only={"cfsan": frame(spark, [("s", 0, "A", "G")], "sample string, pos long, ref string, alt string")})
    assert pairs(rows.where("n = 1"), "name", "value") == [("SNP_CFSAN_only", "\t0\t0\ts:A>G"), ("s_cfsan_gaps", "\t3\t5\tcfsan_gap"), ("s_snp_only", "\t3\t5\tsnp_pipeline_gap")]


def test_small_helpers(tmp_path):
    assert viewer.parse_query("?a=1&b=x%20y+z&c&d=") == {"a": "1", "b": "x y z", "d": ""}
    assert [viewer.duration(s) for s in (0.04, 59.96, 61, 3600)] == ["0.0s", "60.0s", "1m 1s", "60m 0s"]
    assert config.sanitized("a: /x/y/f.vcf\nb: /home/me/g", "/x/y/", "/home/me") == "a: f.vcf\nb: ~/g"
    for f in ("s1_R1.fastq.gz", "s1_R2.fastq.gz", "s2_1.fq", "s2_2.fq", "s3.fastq", "note.txt"):
        (tmp_path / f).write_text("")
    (tmp_path / "s4").mkdir()
    for f in ("reads_R1.fastq", "reads_R2.fastq"):
        (tmp_path / "s4" / f).write_text("")
    got = [(s, a.split("/")[-1], b and b.split("/")[-1]) for s, a, b in config.fastq_samples(str(tmp_path))]
    assert got == [("s1", "s1_R1.fastq.gz", "s1_R2.fastq.gz"), ("s2", "s2_1.fq", "s2_2.fq"), ("s3", "s3.fastq", None), ("s4", "reads_R1.fastq", "reads_R2.fastq")]


def test_without_alignments(spark):
    none = frame(spark, [], "sample string, target string, target_start long, target_end long, matches long, block long")
    offsets = frame(spark, [("c", 0)], "contig string, offset long")
    assert alignments.alignment_metrics(none, offsets, 10).count() == 0
    one = frame(spark, [("s", "c", 0, 8, 4, 8), ("s", "c", 4, 10, 4, 8), ("s", "x", 0, 9, 1, 1)], "sample string, target string, target_start long, target_end long, matches long, block long")
    r = alignments.alignment_metrics(one, offsets, 12).first()
    assert (r.identity, r.coverage, r.merged_coverage) == (0.5, 1.0, pytest.approx(10 / 12))


def test_bases_are_counted_in_bins(spark):
    """Blocks over borders of bins, a long CIGAR and one with other letters; only blocks are shuffled, once."""
    reads = [(250, "5M2D5M", "ACGTACGTAC"), (511, "2S3M", "TTAcN"), (1, "1M1I" * 300, "GT" * 300), (3, "2M4Y1M", "CCC"), (-1, "3M", "AAA")]
    df = spark.createDataFrame(reads, "pos long, cigar string, seq string")
    want = Counter()
    for pos, cigar, seq in reads:
        r, q = pos - 1, 0
        for n, op in re.findall("([0-9]+)([MIDNSHP=X])", cigar):
            for i in range(int(n) if op == "M" else 0):
                want[r + i, seq[q + i].upper()] += 1
            r, q = r + int(n) * (op in "MD"), q + int(n) * (op in "MIS")
    want = {(p, b): n for (p, b), n in want.items() if b != "N"}
    counts = alignments.base_counts(df)
    assert pairs(counts, "pos", "base", "n") == sorted((p, b, n) for (p, b), n in want.items())
    some = spark.createDataFrame([(0,), (255,), (256,), (900,), (255,)], "pos long")
    assert pairs(alignments.base_counts(df, positions=some), "pos", "base", "n") == sorted((p, b, n) for (p, b), n in want.items() if p in (0, 255, 256))
    plan = alignments.base_calls(counts, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_nexus_rows_are_not_shuffled(spark, tmp_path):
    """Pairs are made within the rows of a matrix; what a base is none of, and the reference, count nowhere."""
    rows = ["#NEXUS", "taxlabels\tREF\tA\tB\tC;", "matrix", "1\tA\tA\tC\tN", "2\tA\tG\tG\tT", "3\tC\tA\tC\tG", "4\tC\t-\tt\tG", ";", "end;"]
    p = tmp_path / "x.nex"
    p.write_text("\n".join(rows))
    got = convert.nexus_to_distances(spark, str(p))
    assert pairs(got, "a", "b", "distance") == [("A", "B", 2), ("A", "C", 2), ("B", "C", 2)]
    assert not re.search(r"hashpartitioning\(n#|hashpartitioning\(pos#", got._jdf.queryExecution().executedPlan().toString())
