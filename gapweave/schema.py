"""Schemas of the catalog. Positions are 0-based, intervals half-open, integers 64 bits wide."""

GAP = "pipeline string, sample string, start long, end long"
CALL = "pipeline string, sample string, chrom string, pos long, ref string, alt string, qual double, dp long"
REF_BASE = "pos long, base string"
PIPELINE = "pipeline string, label string, command string, has_vcf boolean, has_bam boolean, reference boolean, from_bam_pileup boolean"
CORE_ALLELE = "pipeline string, chrom string, pos long, ref string, sample string, allele string"
FEATURE = "seqid string, feature_type string, start long, end long, strand string, gene string, locus_tag string, product string, id string"
CONTIG = "sample string, contig string, contig_idx int, length long, sequence string"
