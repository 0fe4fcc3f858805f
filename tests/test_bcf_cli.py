import glob
import gzip
import struct

import numpy as np
import pytest

from conftest import rows_of
from hapframe import cli
from hapframe.operators import route
from hapframe.sources import bcf, vcf

HEAD = "##fileformat=VCFv4.2\n##contig=<ID=chr1>\n##INFO=<ID=DP,Number=1,Type=Integer,Description=\"d\">\n##FORMAT=<ID=GT,Number=1,Type=String,Description=\"g\">\n"
#: Position, alternative alleles, and each sample's alleles; None is missing.
SITES = [(5, 1, [[0, 1], [1, 1]]), (9, 2, [[0, 2], [None, 1]]), (12, 1, [[1], [0, 1]]), (30, 1, [[0, 0], [0, 0]])]


def as_vcf():
    name = lambda g: "|".join("." if a is None else str(a) for a in g)
    rows = [f"chr1\t{p}\t.\tA\t{','.join('CG'[:n])}\t.\t.\t.\tGT:DP\t" + "\t".join(f"{name(g)}:3" for g in samples) for p, n, samples in SITES]
    rows.insert(1, "chr1\t6\t.\tA\tC\t.\t.\t.\tDP\t3\t4")
    return HEAD + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n" + "\n".join(rows) + "\n"


def as_bcf():
    def record(pos, n_alt, formats):
        shared = struct.pack("<iiifII", 0, pos - 1, 1, 0.0, (n_alt + 1) << 16, len(formats) << 24 | 2) + b"\x07" + b"\x17A\x17C\x17G"[: 2 * (n_alt + 1)] + b"\x00"
        own = b"".join(bytes([0x11, key, n << 4 | 1]) + data for key, n, data in formats)
        return struct.pack("<II", len(shared), len(own)) + shared + own

    code = lambda g: bytes([0 if a is None else (a + 1) << 1 | 1 for a in g] + [0x81] * (2 - len(g)))
    depth = (1, 1, b"\x03\x04")
    records = [record(p, n, [depth, (2, 2, b"".join(map(code, samples)))]) for p, n, samples in SITES]
    records.insert(1, record(6, 1, [depth]))
    text = HEAD.encode() + b"\0"
    return b"BCF\2\2" + struct.pack("<I", len(text)) + text + b"".join(records)


def test_bcf_records(spark, tmp_path):
    data, at = as_bcf(), 300
    (tmp_path / "plain.bcf").write_bytes(data)
    (tmp_path / "members.bcf").write_bytes(gzip.compress(data[:at]) + gzip.compress(data[at:]) + gzip.compress(b""))
    want = [(k + (k > 0), p, 2, n + 1, [x for g in samples for x in [14 if a is None else a for a in g] + [15] * (2 - len(g))]) for k, (p, n, samples) in enumerate(SITES)]
    for name in ("plain", "members"):
        rows = bcf.read_bcf(spark, str(tmp_path / f"{name}.bcf")).orderBy("record", "hap").collect()
        got = {}
        for r in rows:
            got.setdefault((r.record, r.pos, r.ploidy, r.n_allele), []).append(r.allele)
        assert [(*k, v) for k, v in got.items()] == want and {r.contig for r in rows} == {"chr1"}
    with pytest.raises(ValueError):
        list(bcf.genotypes(data[:-1]))


@pytest.mark.parametrize("name,flags", [("x.vcf", []), ("x.bcf", ["-z", "-P"]), ("x.vcf", ["-m"]), ("x.bcf", ["-m", "-P"])])
def test_command_line_round_trip(spark, tmp_path, name, flags):
    (tmp_path / name).write_bytes(as_bcf() if name.endswith("bcf") else as_vcf().encode())
    stored, text = str(tmp_path / "archive"), str(tmp_path / "text")
    cli.main(["-c", "-i", str(tmp_path / name), "-o", stored, "--block-sites", "2", *flags])
    cli.main(["-d", "-i", stored, "-o", text])
    lines = [line for path in sorted(glob.glob(f"{text}/part-*")) for line in open(path).read().splitlines()]
    assert lines == ["\t".join("|".join("." if a is None else str(a) for a in g) for g in samples) for _, _, samples in SITES]


def test_vectors_of_both_formats(spark, tmp_path):
    (tmp_path / "x.vcf").write_text(as_vcf())
    (tmp_path / "x.bcf").write_bytes(as_bcf())
    names = ["site_id", "block_id", "group_id", "ploidy", "n_allele", "n", "ac", "n_missing", "n_eov", "observed", "archetype", "rare", "gt"]
    own = [rows_of(kind.read_sites(spark, str(tmp_path / name), 2).select(names)) for kind, name in ((vcf, "x.vcf"), (bcf, "x.bcf"))]
    assert own[0] == own[1] == rows_of(route.site_vectors(vcf.read_alleles(spark, str(tmp_path / "x.vcf")), 2).select(names))
    assert [r.site_id for r in vcf.read_sites(spark, str(tmp_path / "x.vcf")).orderBy("site_id").collect()] == [0, 1, 2, 3]


def test_genotypes_of_odd_records():
    assert vcf.genotype_vector("DP", "3") is None
    for form, samples, want in (("GT", "0|1\t1/.", (2, [0, 1, 1, 14])), ("GT", "10|1\t1", (2, [10, 1, 1, 15])), ("DP:GT", "3:0|2\t4:.", (2, [0, 2, 14, 15])), ("GT", "1", (1, [1])), ("GT:X", "0|1|2:y\t.:z", (3, [0, 1, 2, 14, 15, 15]))):
        ploidy, gt = vcf.genotype_vector(form, samples)
        assert (ploidy, gt.tolist()) == want
    with pytest.raises(ValueError):
        vcf.genotype_vector("GT", "0|14")


def test_text_of_vectors():
    for gt, ploidy, want in (([0, 1, 14, 2], 2, "0|1\t.|2"), ([1, 15, 13, 0], 2, "1\t13|0"), ([0, 1], 1, "0\t1"), ([], 2, ""), ([1, 0, 14], 3, "1|0|.")):
        assert vcf.vector_text(np.array(gt, np.uint8), ploidy) == want
