"""Repeated calls and core lines, and interval operators whose work is cut into bins."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gapweave.functions import intervals as iv
from gapweave.operators import callsets, qc, sites, truth
from gapweave.plans import source_queries, text_queries, views
from gapweave.plans.compare import Comparison
from gapweave.sources import fasta, report, text
from tests.oracle import DATA, connect, same
from tests.test_engine import frame, pairs

CALL = "pipeline string, sample string, pos long, alt string, n long, i int"


def inputs(spark, calls, core=None):
    ref = frame(spark, list(enumerate("ACGTACGTAC")), "pos long, base string")
    gaps = frame(spark, [("p", "S1", 9, 10)], "pipeline string, sample string, start long, end long")
    samples = frame(spark, [("S0",), ("S1",)], "sample string")
    return Comparison(frame(spark, calls, CALL), gaps, ref, samples, 10, "gt", core=core)


def test_equal_calls_are_one(spark):
    x = inputs(spark, [("p", "S0", 4, "C", 1, 0), ("p", "S0", 4, "C", 2, 0), ("p", "S1", 4, "C", 3, 0)])
    assert pairs(x.pairs().where("pipeline = 'p'"), "disc_snps") == [(0,)]
    assert pairs(x.kpis().where("pipeline = 'p'"), "n_sites") == [(1,)]


def test_the_last_line_counts(spark):
    """Calls alike the reference drop out before; a later line, or a later base of one MNP, wins."""
    calls = [("p", "S0", 4, "T", 1, 0), ("p", "S0", 4, "C", 2, 0), ("p", "S0", 4, "A", 3, 0), ("p", "S1", 4, "G", 2, 0), ("p", "S1", 4, "C", 2, 1)]
    x = inputs(spark, calls)
    assert pairs(x.calls, "sample", "pos", "alt") == [("S0", 4, "C"), ("S1", 4, "C")]
    assert pairs(x.pairs().where("pipeline = 'p'"), "disc_snps") == [(0,)]
    plain = sites.last_calls(frame(spark, [("p", "S0", 4, "C"), ("p", "S0", 4, "T")], "pipeline string, sample string, pos long, alt string"))
    assert pairs(plain, "alt") == [("T",)]


def test_truth_with_repeats(spark):
    calls = [("gt", "S0", 4, "C", 1, 0), ("gt", "S0", 4, "C", 2, 0), ("p", "S0", 4, "T", 1, 0), ("p", "S0", 4, "C", 2, 0)]
    got = {r.strategy: r for r in inputs(spark, calls).truth_results().collect()}
    assert (got["gap_union"].gt_disc, got["gap_union"].same_pos, got["gap_union"].concordant) == (1, 1, 1)
    core = frame(spark, [("p", "c1", 4, "S0", "T", 1, 0), ("p", "c1", 4, "S1", "A", 1, 1), ("p", "c2", 4, "S0", "C", 2, 0), ("p", "c2", 4, "S0", "C", 2, 1), ("p", "c2", 4, "S1", "A", 2, 2)], "pipeline string, chrom string, pos long, sample string, allele string, n long, i int")
    x = inputs(spark, calls[:2], core)
    got = {r.strategy: r for r in x.truth_results().collect()}
    assert (got["gap_union"].pl_total_core_snps, got["gap_union"].pl_disc, got["gap_union"].concordant) == (2, 1, 1)
    assert pairs(x.calls.where("pipeline = 'p'"), "sample", "pos", "alt") == [("S0", 4, "C")]
    assert pairs(truth.core_table(core.drop("n", "i")), "pos", "core_disc", "lines") == [(4, True, 2)]


def test_core_alleles_stand_for_calls(spark):
    """The statistics of a pipeline with core alleles come from these; gaps and N are no calls."""
    core = frame(spark, [("p", "c", 4, "S0", "C", 1, 0), ("p", "c", 4, "S1", "-", 1, 1), ("p", "c", 6, "S0", "N", 2, 0), ("p", "c", 6, "S1", "G", 2, 1)], "pipeline string, chrom string, pos long, sample string, allele string, n long, i int")
    x = inputs(spark, [("p", "S0", 2, "T", 1, 0), ("gt", "S0", 2, "T", 1, 0)], core)
    assert pairs(x.calls, "pipeline", "sample", "pos", "alt") == [("gt", "S0", 2, "T"), ("p", "S0", 4, "C")]


def test_vcf_lines_keep_their_order(spark, tmp_path):
    p = tmp_path / "s1.vcf"
    p.write_text("c\t10\t.\tAT\tGC\t50\tPASS\tDP=7\nc\t11\t.\tT\tG\t50\tPASS\tDP=7\nc\t11\t.\tT\tA\t50\tPASS\tDP=7\n")
    calls = text.vcf_calls(spark, str(p)).withColumn("pipeline", F.lit("p")).withColumn("sample", F.lit("s1"))
    assert calls.count() == 4
    assert pairs(sites.last_calls(calls), "pos", "alt") == [(9, "G"), (10, "A")]


def plain_runs(flags):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, i))
            start = None
    return out


@pytest.mark.parametrize("width", [4, 16, 1 << 20])
def test_binned_operators(spark, monkeypatch, width):
    """Merge, complement and runs of many levels against positions, with bins narrower than intervals and empty ones."""
    monkeypatch.setattr(iv, "MERGE_BIN", width)
    rng = random.Random(width)
    length, rows = 200, []
    for key in range(6):
        for _ in range(rng.randrange(1, 14)):
            start = rng.randrange(length)
            rows.append((f"k{key}", start, min(length, start + rng.choice([0, 1, 3, 9, 40]))))
    rows.append(("k7", 0, length))
    df = frame(spark, rows, "key string, start long, end long")
    keys = [f"k{i}" for i in range(9)]  # k8 has no interval
    count = {k: [sum(s <= p < e for x, s, e in rows if x == k) for p in range(length)] for k in keys}
    assert pairs(iv.merge(df, ["key"]), "key", "start", "end") == sorted((k, *r) for k in keys for r in plain_runs([c > 0 for c in count[k]]))
    near = {k: [] for k in keys}
    for k, s, e in sorted((k, *r) for k in keys for r in plain_runs([c > 0 for c in count[k]])):
        if near[k] and s <= near[k][-1][1] + 3:
            near[k][-1][1] = e
        else:
            near[k].append([s, e])
    assert pairs(iv.merge(df, ["key"], 3), "key", "start", "end") == sorted((k, *r) for k in keys for r in near[k])
    lengths = frame(spark, [(k, length) for k in keys], "key string, length long")
    assert pairs(iv.complement(df, ["key"], lengths), "key", "start", "end") == sorted((k, *r) for k in keys for r in plain_runs([c == 0 for c in count[k]]))
    short = frame(spark, [(k, 90) for k in keys], "key string, length long")
    assert pairs(iv.complement(df, ["key"], short), "key", "start", "end") == sorted((k, *r) for k in keys for r in plain_runs([c == 0 for c in count[k][:90]]))
    seg = iv.sweep(df, ["key"], min(width, 65536))
    levels = [1, 2, 4]
    want = sorted((k, level, *r) for k in keys for level in levels for r in plain_runs([c >= level for c in count[k]]))
    assert pairs(iv.level_runs(seg, ["key"], levels, min(width, 65536)), "key", "level", "start", "end") == want


def test_negative_positions(spark):
    df = frame(spark, [("a", -3, 2), ("a", 2, 5), ("a", -9, -7)], "key string, start long, end long")
    assert pairs(iv.merge(df, ["key"]), "start", "end") == [(-9, -7), (-3, 5)]


def test_empty_regions_of_all_thresholds(spark):
    """The published case: 100 positions, four samples; and one sweep in the plan for all thresholds."""
    gaps = frame(spark, [("S1", 20, 30), ("S2", 25, 35), ("S3", 80, 100)], "sample string, start long, end long")
    keys = spark.createDataFrame([(0,)], "x int").select()
    got = qc.empty_regions(gaps, keys, [], 4, (100.0, 75.0, 50.0))
    assert pairs(got, "threshold", "min_samples", "start", "end") == [(75.0, 3, 25, 30), (100.0, 4, 20, 35), (100.0, 4, 80, 100)]
    summary = qc.threshold_summary(got, keys, [], 4, 100, (100.0, 75.0, 50.0))
    assert pairs(summary, "threshold", "core_size", "core_pct", "regions") == [(50.0, 100, 100.0, 0), (75.0, 95, 95.0, 1), (100.0, 65, 65.0, 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS d") <= 2  # the sum of steps of one sweep; both sides of the stitching share its exchange


def test_lines_of_one_number(spark):
    """Of lines with one number the first as they are read counts; the order is definite, so no shuffle decides it."""
    lines = spark.range(0, 4000, 1, 16).selectExpr("'x/a.vcf' AS file", "id % 1000 AS n", "concat_ws('\t', 'c', 1 + id % 1000, '.', 'A', 'C', id div 1000, 'PASS', 'X') AS line")
    got = text.vcf_variants(spark, lines)
    assert got.count() == 1000
    assert got.where("qual != 0").count() == 0
    assert re.search(r"n#\d+L DESC NULLS LAST, _at#\d+L ASC NULLS FIRST", got._jdf.queryExecution().analyzed().toString())


def test_report_parts_are_written(spark):
    """The plan of a report reads its parts, each written by a plan of its own: it joins and broadcasts one row of each."""
    x = inputs(spark, [("gt", "S0", 4, "C", 1, 0), ("p", "S1", 4, "C", 2, 0)])
    out = x.report()
    assert "sites" not in {part.rsplit("/", 2)[-2] for part in out.inputFiles()}
    assert len(out.first().pairs) == 2


def test_parts_grow_with_the_calls(spark, monkeypatch):
    """The number of parts follows the table, not the session, and what groups calls by position stays in them."""
    monkeypatch.setattr(views, "LARGEST_PART", 100)
    v = views.Views(spark, DATA)
    n = v.table("lineitem").count() // 100 + 1
    calls = v.call()
    assert calls.rdd.getNumPartitions() == n > spark.sparkContext.defaultParallelism
    grouped = calls.groupBy("sample", "pos").count()._jdf.queryExecution().executedPlan().toString()
    assert grouped.count("Exchange hashpartitioning") == 1


def test_gaps_with_their_ends(spark):
    """A point at the shared border of two gaps lies in one, so positions need neither be told apart nor joined again."""
    gaps = frame(spark, [("S0", 2, 4), ("S0", 5, 7), ("S0", 7, 7), ("S0", 20, 21)], "sample string, start long, end long")
    assert pairs(iv.closed(gaps, ["sample"]), "start", "end") == [(2, 8), (20, 22)]
    call = frame(spark, [("S0", "c", p, "A", 200.0, 20, 1.0) for p in (1, 2, 4, 5, 7, 8, 21, 22)], "sample string, chrom string, pos long, alt string, qual double, depth int, af double")
    got = callsets.positions(call, call, gaps, "a", "b")
    assert pairs(got, "pos", "in_gap") == [(1, False), (2, True), (4, True), (5, True), (7, True), (8, False), (21, True), (22, False)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join FullOuter") == 1


def test_pages_read_one_table(spark):
    """All orders and pages read the positions that one plan wrote."""
    got = source_queries.QUERIES["next_page"](spark, DATA)
    assert all("/positions/" in f for f in got.inputFiles())
    assert got.count() == 80


def test_unpacked_reference_is_not_broadcast(spark, tmp_path):
    """Bases out of chunks, a document or FASTA are many more bytes than their text, by which Spark decides what the driver may hold."""
    path = str(tmp_path / "report.json")
    x = inputs(spark, [("gt", "S0", 4, "C", 1, 0), ("p", "S1", 4, "C", 2, 0)])
    x.write(path)
    (tmp_path / "doc.json").write_text('{"reference": {"sequence": "ACGTACGTAC"}, "samples": {}, "pipelines": {}, "data": {}, "summary": {"warnings": []}}')
    (tmp_path / "r.fa").write_text(">r\nacgtac\nGTAC\n")
    want = list(enumerate("ACGTACGTAC"))
    for ref in (report.written(spark, path).ref_base, report.document(spark, str(tmp_path / "doc.json")).ref_base, text.ref_base(fasta.chunks(spark, str(tmp_path / "r.fa"), joined=True))):
        assert pairs(ref, "pos", "base") == want
        hit = sites.snps(x.given_calls, ref)
        assert pairs(hit, "sample", "pos", "alt") == [("S0", 4, "C"), ("S1", 4, "C")]
        plan = hit._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and plan.index("SortMergeJoin") < (plan + "BroadcastHashJoin").index("BroadcastHashJoin")


def test_lines_of_one_number_in_several_files(spark, tmp_path):
    """Lines come in the order of file names and rows, as DuckDB on one thread has them; Spark reads the larger file first."""
    con, table = connect(), tmp_path / "lineitem.parquet"
    table.mkdir()
    con.execute(f"COPY (SELECT * FROM lineitem LIMIT 1000) TO '{table}/a.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (l_partkey + 1 AS l_partkey) FROM lineitem) TO '{table}/b.parquet'")
    con.execute(f"SET threads = 1; CREATE OR REPLACE VIEW lineitem AS SELECT * FROM read_parquet('{table}/*.parquet')")
    same(text_queries.QUERIES["vcf_quality_variants"](spark, str(tmp_path)), con, text_queries.ORACLES["vcf_quality_variants"])
