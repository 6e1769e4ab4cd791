"""The published unit cases: interval algebra, coverage, alignments, annotations, calls, configuration."""

import pytest
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.functions import variants as va
from gapweave.operators import alignments, callsets, distances, qc, sites, truth
from gapweave.plans import convert
from gapweave.plans.compare import Comparison
from gapweave.plans.quality import Quality
from gapweave.sources import config, sinks, text


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


GAP = "sample string, start long, end long"


def test_n50(spark):
    c = "sample string, contig string, length long"
    assert qc.n50(frame(spark, [("s", str(i), n) for i, n in enumerate((10, 20, 30, 40))], c)).first().n50 == 30
    assert qc.n50(frame(spark, [("s", "a", 1000)], c)).first().n50 == 1000
    assert qc.n50(frame(spark, [], c)).count() == 0


def test_complement_and_merge(spark):
    ends = frame(spark, [("s", 100)], "sample string, length long")
    assert pairs(iv.complement(frame(spark, [("s", 10, 30), ("s", 50, 80)], GAP), ["sample"], ends), "start", "end") == [(0, 10), (30, 50), (80, 100)]
    assert pairs(iv.complement(frame(spark, [], GAP), ["sample"], ends), "start", "end") == [(0, 100)]
    merged = iv.merge(frame(spark, [("s", 10, 20), ("s", 15, 25), ("s", 30, 40), ("s", 5, 5)], GAP), ["sample"])
    assert pairs(merged, "start", "end") == [(10, 25), (30, 40)]
    assert pairs(iv.merge(merged, ["sample"]), "start", "end") == [(10, 25), (30, 40)]


@pytest.mark.parametrize(("rows", "expected"), [([("a", 10, 20), ("b", 15, 25)], (15, 5, 5 / 15)), ([("a", 10, 20), ("b", 10, 20)], (10, 10, 1.0)), ([("a", 10, 20), ("b", 30, 40)], (20, 0, 0.0)), ([], (0, 0, 1.0))])
def test_pairwise_gaps(spark, rows, expected):
    samples = frame(spark, [("a",), ("b",)], "sample string")
    r = qc.pairwise_gaps(iv.merge(frame(spark, rows, GAP), ["sample"]), samples, [], 50).first()
    assert (r.gap_union, r.gap_intersection, r.quality) == expected
    assert r.core == 50 - expected[0]


def test_regions(spark):
    p = lambda xs: frame(spark, [(x,) for x in xs], "pos long")
    assert pairs(iv.regions(p([1, 2, 3, 10, 11]), []), "start", "end") == [(1, 4), (10, 12)]
    assert pairs(iv.regions(p([1, 2, 3, 10, 11, 12, 20]), [], 5), "start", "end") == [(1, 4), (10, 13), (20, 21)]
    assert pairs(iv.regions(p([1, 2, 3, 10, 11, 12, 20]), [], 6), "start", "end") == [(1, 13), (20, 21)]


def test_thresholds_and_histogram(spark):
    gaps = iv.merge(frame(spark, [("S1", 20, 30), ("S2", 25, 35), ("S3", 80, 100)], GAP), ["sample"]).withColumn("g", F.lit("x"))
    keys = frame(spark, [("x",)], "g string")
    t = {r.threshold: (r.min_samples, r.core_size, r.empty_size) for r in qc.thresholds(gaps, keys, ["g"], 4, 100, (100.0, 75.0, 50.0)).collect()}
    assert t == {100.0: (4, 65, 35), 75.0: (3, 95, 5), 50.0: (2, 100, 0)}
    assert dict(pairs(qc.full_histogram(gaps, keys, ["g"], 4, 100), "covered", "positions")) == {0: 0, 1: 0, 2: 5, 3: 30, 4: 65}
    two = iv.merge(frame(spark, [("S1", 0, 50), ("S2", 0, 50)], GAP), ["sample"]).withColumn("g", F.lit("x"))
    assert dict(pairs(qc.full_histogram(two, keys, ["g"], 4, 100), "covered", "positions")) == {0: 0, 1: 0, 2: 50, 3: 0, 4: 50}


def test_depth_gaps(spark):
    d = frame(spark, list(enumerate([10, 10, 2, 1, 0, 10, 10, 3, 10])), "pos long, depth long")
    assert pairs(iv.depth_gaps(d, [], 5), "start", "end") == [(2, 5), (7, 8)]


def test_sweep_over_bin_borders(spark):
    g = frame(spark, [("a", 5, 25), ("b", 8, 12)], GAP)
    total = iv.sweep(g, [], width=10).groupBy("k").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    assert dict(pairs(total, "k", "n")) == {1: 16, 2: 4}
    p = frame(spark, [(x,) for x in (4, 5, 24, 25)], "pos long")
    assert pairs(iv.locate(p, g.where("sample = 'a'"), [], [], width=10), "pos", "inside") == [(4, False), (5, True), (24, True), (25, False)]


def test_cigar(spark):
    got = frame(spark, [("100M",), ("50M2I48M",), ("50M2D48M",), ("10M1000N90M",)], "c string").select(va.cigar_span("c").alias("n")).collect()
    assert [r.n for r in got] == [100, 98, 100, 1100]


def test_pileup(spark):
    reads = frame(spark, [("r1", 0, "c", 1, "3M1D2M", "ACGTT"), ("r2", 0, "c", 1, "1S3M", "TACG"), ("r3", 4, "c", 1, "*", "A")], "name string, flag int, contig string, pos long, cigar string, seq string")
    counts = alignments.base_counts(reads.where("cigar != '*'"))
    assert pairs(counts, "pos", "base", "n") == [(0, "A", 2), (1, "C", 2), (2, "G", 2), (4, "T", 1), (5, "T", 1)]
    ref = frame(spark, list(enumerate("AGGTTT")), "pos long, base string")
    assert pairs(alignments.pileup_snps(counts, ref, 2, 0.8), "pos", "ref", "alt") == [(2, "G", "C")]
    c = alignments.pileup_counts(counts, ref, 2, 0.8).first()
    assert (c.snps, c.covered) == (1, 3)
    assert pairs(alignments.base_calls(counts, 2), "pos", "call") == [(0, "A"), (1, "C"), (2, "G"), (4, "-"), (5, "-")]
    assert pairs(alignments.low_coverage(reads, 8, 1), "start", "end") == [(6, 8)]


def test_mpileup(spark):
    text = frame(spark, [(".,A^].", "g"), ("A+1CTG", "a")], "bases string, ref string")
    assert [r.d for r in text.select(alignments.decoded(F.col("bases"), F.col("ref")).alias("d")).collect()] == ["GGAG", "AG"]
    rows = frame(spark, [("s", "c", 5, "G", "..,A"), ("s", "c", 6, "G", "..")], "sample string, chrom string, pos long, ref string, bases string")
    assert pairs(alignments.mpileup_consensus(rows), "pos", "base") == [(5, "G"), (6, None)]


def test_predicates(spark):
    d = frame(spark, [("A", "G"), ("AT", "GC"), ("A", "AT"), ("A", "G,T"), ("A", "."), ("AT", "A,C")], "ref string, alt string")
    got = d.select(va.is_snp("ref", "alt"), va.is_mnp("ref", "alt"), va.is_indel("ref", "alt")).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, True, False), (False, False, True), (False, False, True), (False, False, False), (False, False, True)]
    parts = frame(spark, [(10, "ATG", "ACC")], "pos long, ref string, alt string").select(va.decompose("pos", "ref", "alt").alias("d")).first().d
    assert [tuple(x) for x in parts] == [(11, "T", "C"), (12, "G", "C")]


def test_vcf(spark, tmp_path):
    p = tmp_path / "s1.vcf"
    p.write_text("##x\n#CHROM\nc\t10\t.\tA\tG\t50\tPASS\tDP=7\tGT:DP:AD\t0/1:9:2,6\nc\t11\t.\tA\tG\t.\tLow\tADP=3\nc\t12\t.\tAT\tGC\t5\tPASS\tX\nc\t20\t.\tA\tAT\t90\tPASS\tDP=1\nbad line\nc\tx\t.\tA\tC\t90\tPASS\tDP=1\n")
    calls = text.vcf_calls(spark, str(p), min_qual=20)
    assert pairs(calls, "pos", "alt", "qual", "dp") == [(9, "G", 50.0, 7), (10, "G", 0.0, 3)]
    every = text.vcf_calls(spark, str(p), include_indels=True)
    assert pairs(every, "pos", "ref", "alt") == [(9, "A", "G"), (10, "A", "G"), (11, "A", "G"), (12, "T", "C"), (19, "A", "AT")]
    v = {r.pos: r for r in text.vcf_variants(spark, str(p)).collect()}
    assert v[10].sample == "s1"
    assert (v[10].depth, v[10].af, v[10].gt) == (9, 0.75, "0/1")
    assert v[12].info.endswith("DECOMPOSED_FROM_MNP=AT>GC")


def test_text_formats(spark, tmp_path):
    fa = tmp_path / "x.fasta"
    fa.write_text(">c1 first\nACGT\nAC\n>c2\nnnA\n")
    c = text.fasta(spark, str(fa))
    assert pairs(c, "sample", "contig", "contig_idx", "length", "sequence") == [("x", "c1", 0, 6, "ACGTAC"), ("x", "c2", 1, 3, "NNA")]
    assert pairs(text.ref_base(c), "pos", "base")[-1] == (8, "A")
    assert pairs(text.masked_gaps(c), "sample", "start", "end") == [("x", 7, 9)]
    r = text.reference(spark, str(fa)).first()
    assert (r.name, r.length, r.sequence) == ("c2", 9, "ACGTACnnA")
    t = tmp_path / "core.tsv"
    t.write_text("CHR\tPOS\tREF\ts1_snippy_snippy\ts2\nc\t5\tA\tG\t-\nc\t0\tA\tG\tG\n")
    core = text.core_snps(spark, str(t), "p")
    assert pairs(core, "pos", "sample", "allele") == [(4, "s1", "G"), (4, "s2", "-")]
    assert [tuple(x) for x in sinks.core_wide(core, ["s1", "s2"]).collect()] == [("c", 5, "A", "G", "-")]
    g = tmp_path / "a.gff"
    g.write_text("##gff\nc\tx\tgene\t100\t200\t.\t+\t.\tID=gene-lmo0001;Name=dnaA;locus_tag=lmo0001;product=DnaA protein\n")
    f = text.gff(spark, str(g)).first()
    assert (f.gene, f.locus_tag, f.product, f.start, f.end) == ("dnaA", "lmo0001", "DnaA protein", 100, 200)
    assert f.end - max(f.start - 1, 99 + 50) == 51
    pf = tmp_path / "x.paf"
    pf.write_text("q\t3000000\t0\t2999000\t+\tt\t3000000\t0\t2998900\t2990000\t2998900\t60\nq\tx\n")
    a = text.paf(spark, str(pf)).first()
    assert (a.query_len, a.matches, a.block) == (3000000, 2990000, 2998900)
    m = tmp_path / "d.tsv"
    m.write_text("\ts1\ts2\ns1\t0\t3\ns2\t3\tx\n")
    assert pairs(text.distance_matrix(spark, str(m)), "row", "col", "distance") == [("s1", "s1", 0), ("s1", "s2", 3), ("s2", "s1", 3), ("s2", "s2", 0)]
    assert pairs(convert.convert(spark, "core", "distances", str(t)), "distance") == [(0,)]


def test_config():
    d = {"reference": "r.fa", "pipelines": {"gt": {"reference": True, "samples": {"s1": {"bam": "a.bam"}}}, "p": {"samples": {"s1": {"vcf": "a.vcf"}}}}, "options": {"min_qual": 20}}
    c = config.parse(d, check_files=False)
    assert (c.truth, c.sample_ids(), c.options["min_depth"], c.options["min_qual"]) == ("gt", ["s1"], 1, 20)
    assert config.parse({k: v for k, v in d.items() if k != "options"}, check_files=False).options["min_depth"] == 0
    with pytest.raises(ValueError, match="pipeline"):
        config.parse({"reference": "r.fa"})


def micro(spark):
    """Ten bases, three samples; positions 0-based, gaps 1-based as files have them."""
    calls = [("s1", 2, "T"), ("s1", 5, "A"), ("s1", 7, "C"), ("s1", 8, "A"), ("s2", 2, "T"), ("s2", 5, "G"), ("s2", 7, "C"), ("s3", 2, "T")]
    c = frame(spark, [("gt", *x) for x in calls], "pipeline string, sample string, pos long, alt string")
    g = frame(spark, [("gt", "s2", 2, 3), ("gt", "s3", 6, 7)], "pipeline string, sample string, start long, end long")
    ref = frame(spark, list(enumerate("ACGTACGTAC")), "pos long, base string")
    return c, g, ref, frame(spark, [("s1",), ("s2",), ("s3",)], "sample string")


@pytest.mark.parametrize(
    ("compat", "union", "intersect", "truth_union", "pair_rows", "usable"),
    [(True, (2, 0, 2, 0), (3, 1, 2, 1), [5, 7], [(9, 1), (9, 2), (8, 2)], 26 / 3), (False, (2, 1, 1, 0), (3, 1, 2, 1), [7], [(9, 1), (9, 1), (8, 1)], 26 / 3)],
)
def test_coordinates(spark, compat, union, intersect, truth_union, pair_rows, usable):
    c, g, ref, s = micro(spark)
    x = Comparison(c, g, ref, s, 10, coord_compat=compat)
    stats = {r.strategy: (r.total_snps, r.consensus_snps, r.disc_snps, r.missing_vcf) for r in x.global_stats().collect()}
    assert (stats["gap_union"], stats["gap_intersect"]) == (union, intersect)
    assert [p for (p,) in pairs(truth.truth_disc(x.sites, "gap_union"), "pos")] == truth_union
    assert [p for (p,) in pairs(truth.truth_disc(x.sites, "gap_intersect"), "pos")] == [5, 7]
    rows = x.pairs().orderBy("a", "b").collect()
    assert [(r.usable_space, r.disc_snps) for r in rows] == pair_rows
    assert sites.pair_summary(x.pairs()).first().usable_avg == pytest.approx(usable)
    assert x.report().count() == 1


def test_distance_and_validation(spark):
    al = frame(spark, [(1, "a", "A"), (1, "b", "C"), (2, "a", "N"), (2, "b", "C"), (3, "a", "T"), (3, "b", "T")], "pos long, sample string, allele string")
    s = frame(spark, [("a",), ("b",)], "sample string")
    assert pairs(distances.hamming(al, s), "a", "b", "distance") == [("a", "b", 1)]
    assert pairs(distances.square(distances.hamming(al, s), s), "row", "col", "distance") == [("a", "a", 0), ("a", "b", 1), ("b", "a", 1), ("b", "b", 0)]
    o = frame(spark, [("a", "c", 1, "A"), ("b", "c", 1, "A"), ("a", "c", 2, "A"), ("b", "c", 2, "G"), ("a", "c", 3, None), ("a", "c", 4, "T")], "sample string, chrom string, pos long, base string")
    assert pairs(callsets.validate(o), "pos", "verdict") == [(1, "artifact"), (2, "real"), (3, "no_data"), (4, "real")]


def test_interpretation(spark):
    d = frame(spark, [(10, 5, 1, 1, 0)], "concordant long, only_a long, only_b long, a_only_in_gaps long, b_only_in_gaps long")
    got = d.select(callsets.interpretation("p", "q").alias("t")).first().t
    assert got == "Moderate agreement (62.5% concordance) - review discordant positions. p found 5x more unique SNPs than q - possible q sensitivity issue. 1 SNPs unique to p and 0 unique to q are in low-coverage regions"


def test_merge_over_bin_borders(spark, monkeypatch):
    import random

    from gapweave.functions import intervals as iv

    monkeypatch.setattr(iv, "MERGE_BIN", 8)
    rng = random.Random(6)
    for reach in (0, 3):
        rows = [(k, s, s + rng.choice([1, 1, 2, 3, 30])) for k in "abcd" for s in rng.sample(range(400), 45)]
        want = []
        for k in "abcd":
            now = []
            for s, e in sorted((s, e) for x, s, e in rows if x == k):
                if now and s <= now[-1][1] + reach:
                    now[-1][1] = max(now[-1][1], e)
                else:
                    now.append([s, e])
            want += [(k, s, e) for s, e in now]
        got = iv.merge(spark.createDataFrame(rows, "k string, start long, end long"), ["k"], reach)
        assert sorted(map(tuple, got.select("k", "start", "end").collect())) == sorted(want)
    assert [tuple(r) for r in iv.merge(spark.createDataFrame([(0, 20), (19, 40), (50, 51)], "start long, end long"), []).orderBy("start").collect()] == [(0, 40), (50, 51)]
    assert iv.merge(spark.createDataFrame([], "k string, start long, end long"), ["k"]).count() == 0


def test_report(spark, tmp_path):
    import json

    from gapweave import schema

    files = {"gt": {"reference": True, "label": "Truth", "samples": {"s1": {"bam": "a.bam"}, "s2": {"bam": "b.bam"}}}, "p": {"command": "run", "samples": {"s1": {"vcf": "a.vcf", "bam": "a2.bam"}, "s3": {"vcf": "c.vcf"}}}}
    project = config.parse({"reference": "r.fa", "pipelines": files}, check_files=False)
    assert project.pipeline_rows() == [("gt", "Truth", None, True, True, True, True), ("p", None, "run", True, True, False, False)]
    assert project.file_paths() == [("s1", "gt", None, "a.bam"), ("s1", "p", "a.vcf", "a2.bam"), ("s2", "gt", None, "b.bam"), ("s3", "p", "c.vcf", None)]

    c, g, ref, _ = micro(spark)
    c = c.unionByName(c.where("pos != 5").withColumn("pipeline", F.lit("p")))
    s = frame(spark, [("s1", "One"), ("s2", None), ("s3", None)], "sample string, label string")
    d = frame(spark, [("p", "s1", "s2", 4), ("p", "s2", "s1", 4)], "pipeline string, row string, col string, distance long")
    x = Comparison(c, g, ref, s, 10, "gt", about=frame(spark, project.pipeline_rows(), schema.PIPELINE), distances=d, warnings=frame(spark, [("late",), ("early",)], "text string"))
    out = str(tmp_path / "report.json")
    x.write(out)
    r = json.loads("".join(q.read_text() for q in (tmp_path / "report.json").glob("part-*")))
    assert r["schema_version"] == "2.0" and r["ref_length"] == 10
    assert r["samples"] == [{"sample": "s1", "label": "One"}, {"sample": "s2"}, {"sample": "s3"}]
    assert [(p["pipeline"], p["has_vcf"], p["from_bam_pileup"]) for p in r["pipelines"]] == [("gt", True, True), ("p", True, False)]
    assert r["warnings"] == ["early", "late"]
    assert [m["distance"] for m in r["distances"]] == [4, 4]
    assert [(p["a"], p["b"], p["usable_space"], p["disc_snps"]) for p in r["pairs"] if p["pipeline"] == "gt"] == [("s1", "s2", 9, 1), ("s1", "s3", 9, 2), ("s2", "s3", 8, 2)]
    assert {p["pipeline"]: p["num_pairs"] for p in r["pair_summary"]} == {"gt": 3, "p": 3}
    assert [p["avg_disc_snps"] for p in r["per_sample"] if p["pipeline"] == "gt"] == [1.5, 1.5, 2.0]
    assert {p["pipeline"] for p in r["truth"]} == {"p"}
    assert [(p["pipeline"], p["gap_affected"]) for p in r["breakdown"]] == [("p", 0)]
    rows = spark.read.json(out + ".data")
    assert pairs(rows.where("kind = 'gap'"), "sample", "start", "end") == [("s2", 2, 3), ("s3", 6, 7)]
    assert rows.where("kind = 'snp'").count() == c.count()
    assert pairs(rows.where("kind = 'snp' AND pipeline = 'p'"), "sample", "start", "alt") == [("s1", 3, "T"), ("s1", 8, "C"), ("s1", 9, "A"), ("s2", 3, "T"), ("s2", 8, "C"), ("s3", 3, "T")]
    small = str(tmp_path / "small.json")
    Comparison(c.limit(0), g.limit(0), ref, s, 10).write(small, dashboard=True)
    assert not (tmp_path / "small.json.data").exists()
    r = json.loads("".join(q.read_text() for q in (tmp_path / "small.json").glob("part-*")))
    assert r["kpis"] == [] and r["pairs"] == [] and "truth" not in r


def test_vcf_folder(spark, tmp_path):
    for name in ("a.vcf", "b.txt", "samples/x/var.flt.vcf", "samples/y/other.vcf", "s1_snippy/snps.filt.vcf", "s1_snippy/snps.vcf", "s2_snippy/s2_snippy.vcf", "s2_snippy/z.vcf", "s3_snippy/q.raw.vcf", "s3_snippy/m.vcf", "s4_snippy/q.subs.vcf", "else/e.vcf"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("#CHROM\n")
    names = lambda found: [x.split(str(tmp_path), 1)[1].lstrip("/") for x in found]
    plain = ["a.vcf", "s1_snippy/snps.vcf", "s2_snippy/s2_snippy.vcf", "s3_snippy/m.vcf"]
    assert names(text.vcf_folder(spark, str(tmp_path))) == plain
    assert names(text.vcf_folder(spark, str(tmp_path), "cfsan")) == sorted([*plain, "samples/x/var.flt.vcf"])


def test_quality_report(spark, tmp_path):
    import json

    gaps = frame(spark, [("s1", 0, 10), ("s2", 5, 15)], GAP)
    contigs = frame(spark, [("s1", "c1", 60), ("s1", "c2", 40), ("s2", "c1", 90)], "sample string, contig string, length long")
    aligned = frame(spark, [("s1", 0.99, 0.98, 0.9), ("s2", 0.97, 0.96, 0.8)], "sample string, identity double, sample_coverage double, reference_coverage double")
    q = Quality(gaps, contigs, aligned, "ref", 100, samples=frame(spark, [("s1",), ("s2",), ("s3",)], "sample string"))
    out, lines = tmp_path / "q.json", tmp_path / "q.tsv"
    q.write(str(out))
    r = json.loads("".join(p.read_text() for p in out.glob("part-*")))
    assert r["summary"][0]["total"] == 2 and r["summary"][0]["min_coverage"] == 0.8
    assert (r["reference"][0]["reference_name"], r["reference"][0]["reference_length"], r["reference"][0]["avg_identity"]) == ("ref", 100, pytest.approx(0.98))
    assert [(s["sample"], s["n50"], s["n_contigs"]) for s in r["samples"]] == [("s1", 60, 2), ("s2", 90, 1)]
    assert [(p["a"], p["b"]) for p in r["pairs"]] == [("s1", "s2"), ("s1", "s3"), ("s2", "s3")]
    assert r["pairs"][0]["quality"] == pytest.approx(1 / 3)
    assert {p["sample"] for p in r["impact"]} == {"s1", "s2", "s3"}
    assert [(t["threshold"], t["core_size"], t["regions"], t["longest"]) for t in r["thresholds"] if t["threshold"] in (100.0, 50.0, 25.0)] == [(25.0, 100, 0, 0), (50.0, 95, 1, 5), (100.0, 85, 1, 15)]
    assert [(h["covered"], h["positions"]) for h in r["histogram"]] == [(0, 0), (1, 5), (2, 10), (3, 85)]
    assert r["fragile"] == []
    q.write(str(lines))
    (part,) = lines.glob("part-*")
    rows = part.read_text().splitlines()
    assert rows[0].startswith("sample\tscore\tflagged") and [x.split("\t")[0] for x in rows[1:3]] == ["s1", "s2"]
    assert rows[3:6] == ["", "# Gap Quality Matrix (intersection/union)", "sample\ts1\ts2\ts3"] and rows[6].startswith("s1\t1.0000\t0.3333\t")
    assert rows[9:13] == ["", "# Reference Summary", "reference_name\tref", "reference_length\t100"]
