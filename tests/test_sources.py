import gzip

import pytest

from strandloom.sources import readers as rd
from strandloom.sources import writers as wr


def put(path, text, mode="w"):
    with open(path, mode, encoding=None if "b" in mode else "utf-8", newline=None if "b" in mode else "") as f:
        f.write(text)
    return str(path)


def test_ragged_peaks(spark, tmp_path, rows):
    p = put(tmp_path / "p", "# note\nchr2L\t10\t30\t.\t0\t.\t5.5\t-1\t-1\t7\nchrX\t1\t9\tn\t600\t+\t-1\t-1\t2\t-1\textra\t2.0\n\nbad\tx\ty\n")
    got = rd.read_narrow_peaks(spark, p)
    assert rows(got, "chrom", "summit", "signal_value", "q_value") == [("bad", None, None, None), ("chr2L", 17, 5.5, None), ("chrX", None, None, 2.0)]
    assert rows(rd.read_narrow_peaks(spark, p, "absolute"), "chrom", "summit") == [("bad", None), ("chr2L", 7), ("chrX", None)]
    assert rows(rd.read_replicate_peaks(spark, p), "chrom") == [("chrX",)]
    assert rows(rd.read_bed(spark, p, start_base=1), "chrom", "chrom_start") == [("bad", None), ("chr2L", 9), ("chrX", 0)]


def test_sequences_and_matrices(spark, tmp_path, rows):
    f = put(tmp_path / "f.fa", ">a one\r\nac\r\nGT\n>b\n\n>c\nNNA")
    assert rows(rd.read_fasta(spark, f)) == [("a", "ACGT"), ("b", ""), ("c", "NNA")]
    m = put(tmp_path / "m.meme", "MEME version 4\n\nMOTIF M1 x\nletter-probability matrix: alength= 4 w= 2 nsites= 5 E= 1e-3\n 0.1 0.2 0.3 0.4\n 1 0 0 0\n\nMOTIF M2\nletter-probability matrix: alength= 4 w= 1\n 0 0 0 1\n")
    assert rows(rd.read_matrices(spark, m)) == [("M1", 1, 0.1, 0.2, 0.3, 0.4), ("M1", 2, 1.0, 0.0, 0.0, 0.0), ("M2", 1, 0.0, 0.0, 0.0, 1.0)]
    s = put(tmp_path / "s.txt", "MOTIF 1-ACGTG STREME-1\nletter-probability matrix: w= 5 E= 2.0e-005\n0 0 0 1\nMOTIF 2-TTT STREME-2\nletter-probability matrix: w= 3 E= 4.1e+000\n")
    assert rows(rd.read_discovery(spark, s, "CGTG"), "rank", "consensus", "e_value", "wanted") == [(1, "ACGTG", 2e-05, True), (2, "TTT", 4.1, False)]
    c = put(tmp_path / "c.cb", ">m1\n1 1 2 0\n0 0 0 0\n>m2\n5 0 0 5\n")
    assert rows(rd.read_count_matrices(spark, c)) == [("m1", 1, 0.25, 0.25, 0.5, 0.0), ("m1", 2, 0.0, 0.0, 0.0, 0.0), ("m2", 1, 0.5, 0.0, 0.0, 0.5)]


def test_small_tables(spark, tmp_path, rows):
    d = put(tmp_path / "d.csv", "﻿gene;a;b\nx;1,5; 2\ny;#VALUE!;NA\nz;3;-0,25\n")
    assert rows(rd.read_decimal_comma(spark, d, ["a", "b"])) == [("x", 1.5, 2.0), ("y", None, None), ("z", 3.0, -0.25)]
    g = put(tmp_path / "g", 'genes\n"FBgn0001"\n FBgn0002 \nFBgn0001,more\nother\n')
    assert rows(rd.read_gene_list(spark, g)) == [("FBgn0001",), ("FBgn0002",)]
    z = tmp_path / "t.gz"
    put(z, gzip.compress(b"# skipped\na\tb\n1\t2\n"), "wb")
    assert rows(rd.read_table_skipping(spark, str(z))) == [(2, ["a", "b"]), (3, ["1", "2"])]
    q = put(tmp_path / "q", "f.bam\t100\t185,200,-5\t0.1\n")
    assert rows(rd.read_quality(spark, q), "fragment") == [(185,)]
    log = put(tmp_path / "log", "Number of peaks passing: 123/456\nreports/abc0f1/x reports/ff/y")
    assert rows(rd.scrape(spark, log, {"n": r"passing: (\d+)", "id": r"reports/([0-9a-f]+)", "no": "zz(z)"}), "n", "id", "no") == [("123", "abc0f1", None)]
    assert rd.same_content(spark, log, log) and not rd.same_content(spark, log, q)


def test_tracks_and_hits(spark, tmp_path, rows):
    (tmp_path / "t").mkdir()
    put(tmp_path / "t" / "st11_H3K27ac.bedgraph", "track x\nchr2L 1 5 0.5\nchr2L 1 5 0.5\nchr2L 9 9 1\nchr2L 3 x 1\nchrX 1 2 NA\n")
    assert rows(rd.read_tracks(spark, str(tmp_path / "t"))) == [("st11", "H3K27ac", "chr2L", 1, 5, 0.5)]
    h = put(tmp_path / "fimo.tsv", "motif_id\tmotif_alt_id\tsequence_name\tstart\tstop\tstrand\tscore\tp-value\tq-value\tmatched_sequence\nM1\t\tpeak_1\t3\t9\t+\t9.5\t1e-5\t0.01\tACGT\nM2\t\tpeak_1\t3\t9\t-\tx\t\t\t\n\n# FIMO (Find Individual Motif Occurrences)\n")
    assert rows(rd.read_hits(spark, h), "motif_id", "start", "score", "q_value") == [("M1", 3, 9.5, 0.01), ("M2", 3, None, None)]
    assert rd.read_hits(spark, h, "M1").count() == 1


def test_writers_and_rules(spark, tmp_path, rows):
    p = spark.createDataFrame([("chr2L", -5, 10, "a", None), ("chrX", 3, 9, None, "+")], "chrom string, chrom_start bigint, chrom_end bigint, name string, strand string")
    wr.write_bed(p, str(tmp_path / "b"), strand="?")
    assert rows(rd.read_bed(spark, str(tmp_path / "b")), "chrom_start", "name", "strand") == [(0, "a", "?"), (3, ".", "+")]
    assert wr.checked_bed(spark, str(tmp_path / "b")).count() == 0
    assert wr.checked_bed(spark, put(tmp_path / "bad", "chr\t5\t5\tn\t0\t.\nchr\t1\t2\n")).count() == 2
    seqs = spark.createDataFrame([("x", "ACGT"), ("y", None)], "n string, s string")
    wr.write_fasta(seqs, "n", "s", str(tmp_path / "fa"))
    assert rows(rd.read_fasta(spark, str(tmp_path / "fa"))) == [("x", "ACGT")]


def test_store(spark, tmp_path, rows):
    store = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), (None, "c", "3")], "section string, name string, value string")
    new = spark.createDataFrame([("s", "b", "9"), ("s", "b", "8"), (None, "c", "4"), ("t", "d", "5")], "section string, name string, value string")
    assert rows(wr.upsert(store, new, ["section", "name"])) == [("s", "a", "1"), ("s", "b", "9"), ("t", "d", "5"), (None, "c", "4")]
    assert wr.value_of(store, "name", "value", "b") == "2" and wr.value_of(store, "name", "value", "zz") is None
    path = str(tmp_path / "out")
    assert wr.verified_overwrite(spark, store, path) is True and wr.verified_overwrite(spark, store, path) is False
    with pytest.raises(ValueError):
        wr.verified_overwrite(spark, new, path)
    made = []

    def make():
        made.append(1)
        return store

    for n in (1, 1, 2):
        wr.cached(spark, str(tmp_path / "cache"), {"n": n}, make)
    assert len(made) == 2
