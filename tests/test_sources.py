import random
import re

import pytest

from weftline.operators.mapping import map_files, map_reads, map_reads_approx
from weftline.sources import raw_records, sequence_files as sf


def test_fasta_file(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">foo\nfoobar\nbazqax\n> q\tu>x \r\nqua\r\nxa\n>empty\n\n>mid\nAC G\nT>n>e xt\nTT\n")
    got = [(r.ord, r.name, r.seq) for r in sf.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("ord").collect()]
    assert got == [(0, "foo", "foobarbazqax"), (1, "qux", "quaxa"), (2, "empty", ""), (3, "mid", "ACGT"), (4, "next", "TT")]


def test_many_records_keep_their_order(spark, tmp_path):
    rng = random.Random(1)
    records = [(f"chrom{i}", "".join(rng.choice("abct") for _ in range(100))) for i in range(500)]
    (tmp_path / "g.fa").write_text("".join(f">{n}\n{s[:80]}\n{s[80:]}\n" for n, s in records))
    (tmp_path / "r.fq").write_text("".join(f"@read{i}\n{s[i % 50 : i % 50 + 10]}\n+\n{'~' * 10}\n" for i, (_, s) in enumerate(records)))
    (tmp_path / "two.fq").write_text("".join(f"@read{i}\n{s[:10]}\n" for i, (_, s) in enumerate(records)))
    fasta, fastq = sf.read_fasta(spark, str(tmp_path / "g.fa")), sf.read_fastq(spark, str(tmp_path / "r.fq"))
    assert [(r.name, r.seq) for r in fasta.orderBy("ord").collect()] == records
    assert [(r.ord, r.name, r.qual) for r in fastq.orderBy("ord").collect()] == [(i, f"read{i}", "~" * 10) for i in range(500)]
    assert sf.read_fastq(spark, str(tmp_path / "two.fq"), 2).where("seq IS NOT NULL AND qual IS NULL").count() == 500
    want = sorted((f"read{i}", n, m.start() + 1, "10M") for i, (_, s) in enumerate(records) for n, x in records for m in re.finditer(f"(?={s[i % 50 : i % 50 + 10]})", x))
    for strategy in ("seed", "automaton"):
        rows = map_reads(fastq, fasta, strategy)
        assert sorted((r.qname, r.rname, r.pos, r.cigar) for r in rows.collect()) == want
    near = map_reads_approx(fastq.where("ord < 5"), fasta.where("ord < 20"), 1)
    assert near.where("cigar = '10M'").count() >= 5
    sf.write_sam(rows, str(tmp_path / "out"))
    assert sorted((r.qname, r.rname, r.pos, r.cigar) for r in sf.read_sam(spark, str(tmp_path / "out")).collect()) == want


@pytest.fixture
def small_splits(spark):
    for k, v in (("spark.sql.files.maxPartitionBytes", "4000"), ("spark.sql.files.openCostInBytes", "10")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def test_folders_of_files_in_small_splits(spark, tmp_path, small_splits):
    """Records of several files of unequal length, some without a line end, each in several splits."""
    rng = random.Random(7)
    fasta, fastq = [], []
    for folder in ("fa", "fq"):
        (tmp_path / folder).mkdir()
    for f, n in (("a", 300), ("b", 517), ("c", 3), ("d", 0), ("e", 150)):
        part = [(f"{f}{i}", "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 7, 60, 400])))) for i in range(n)]
        fasta += part
        text = "".join(f">{name}\n" + "".join(f"{s[i : i + 60]}\n" for i in range(0, len(s), 60)) for name, s in part)
        (tmp_path / "fa" / f"{f}.fa").write_text(("; before the first name\n" if n else "") + text.rstrip("\n"))
        reads = [(name, s[:50], "~" * len(s[:50])) for name, s in part]
        fastq += reads
        (tmp_path / "fq" / f"{f}.fq").write_text("".join(f"@{name}\n{s}\n+\n{q}\n" for name, s, q in reads))
    assert spark.read.text(str(tmp_path / "fa")).rdd.getNumPartitions() > 20
    got = sf.read_fasta(spark, str(tmp_path / "fa")).orderBy("ord").collect()
    assert [r.ord for r in got] == [*range(len(fasta))] and [(r.name, r.seq) for r in got] == fasta
    got = sf.read_fastq(spark, str(tmp_path / "fq")).orderBy("ord").collect()
    assert [r.ord for r in got] == [*range(len(fastq))] and [(r.name, r.seq, r.qual) for r in got] == fastq
    # A file whose last record is cut off doesn't shift the records of the next one.
    (tmp_path / "fq" / "b.fq").write_text("@cut\nAC\n")
    got = [(r.name, r.seq, r.qual) for r in sf.read_fastq(spark, str(tmp_path / "fq")).orderBy("ord").collect()]
    assert got == [*fastq[:300], ("cut", "AC", None), *fastq[817:]]


def test_files_to_files(spark, tmp_path, small_splits):
    rng = random.Random(8)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    sequences = spark.createDataFrame([(f"s{i}", dna(500)) for i in range(20)] + [("none", None)], "name string, seq string").repartition(3)
    whole = {r.name: r.seq or "" for r in sequences.collect()}
    reads = [(f"r{i}", whole[f"s{i % 20}"][i : i + 20]) for i in range(100)] + [("away", dna(25))]
    sf.write_fasta(sequences, str(tmp_path / "fa"), 70)
    sf.write_fastq(spark.createDataFrame([(n, s, "!" * len(s)) for n, s in reads], "name string, seq string, qual string").repartition(4), str(tmp_path / "fq"))
    assert {r.name: r.seq for r in sf.read_fasta(spark, str(tmp_path / "fa")).collect()} == whole
    want = sorted((n, t, m.start() + 1, "20M", s) for n, s in reads for t, x in whole.items() for m in re.finditer(f"(?={s})", x))
    for algorithm in ("naive", "ba", "seed"):
        map_files(spark, algorithm, str(tmp_path / "fa"), str(tmp_path / "fq"), str(tmp_path / algorithm))
        assert sorted(map(tuple, sf.read_sam(spark, str(tmp_path / algorithm)).collect())) == want
    with pytest.raises(ValueError):
        map_files(spark, "other", "", "", "")


def test_odd_records(spark):
    schema = "ord bigint, name string, seq string, qual string, read_at string, text string"
    rows = [(1, "@r1 x/1", "ac\tGT", "!!", "a", "z"), (1, "@r1 x/1", "ac\tGT", "!!", "b", "z"), (2, None, None, None, None, None), (3, "", "", "", "", ""), (4, "r/4", "AAAA", "", "", "")]
    got = sorted((r.ord, r.name, r.seq) for r in sf.fastq_records(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, "r1", "ACGT"), (2, None, None), (3, "", ""), (4, "r", "AAAA")]
    fasta = spark.createDataFrame([(1, ">c >1", "aACGTAAAA", "x"), (2, None, "ACGT", "y"), (3, "e", None, "z"), (4, "f", "", "z")], "ord bigint, name string, seq string, qual string")
    mapped = sorted(map(tuple, map_reads(spark.createDataFrame(rows, schema), fasta).collect()), key=str)
    assert mapped == sorted([("r", "c1", 6, "4M", "AAAA"), ("r1", "c1", 2, "4M", "ACGT"), ("r1", None, 1, "4M", "ACGT")], key=str)
    assert map_reads(spark.createDataFrame([], schema), fasta).count() == 0


def reason(kind, text):
    """The rules, row by row."""
    if text is None:
        return "quoting"
    text = text[:-1] if text.endswith("\r") else text
    fields, at = [], 0
    while True:
        m = re.compile(r'"(?:[^"]|"")*"|[^",]*').match(text, at)
        fields.append(m[0][1:-1].replace('""', '"') if m[0].startswith('"') else m[0])
        at = m.end()
        if at == len(text):
            break
        if text[at] != ",":
            return "quoting"
        at += 1
    if len(fields) != {"fastq": 4, "fasta": 3}.get(kind):
        return "columns"
    seq = re.sub(r"[ \t\r\n]", "", fields[2]).upper()
    ok = re.fullmatch("[0-9]{1,18}", fields[0]) and re.fullmatch("[ACGTN]+", seq)
    if kind == "fastq":
        ok = ok and re.fullmatch("@[!-~]+", fields[1]) and re.fullmatch("[!-~]*", fields[3]) and len(fields[3]) == len(seq)
    else:
        ok = ok and re.fullmatch(r">[ -~\t]*", fields[1]) and re.sub("[> \t]", "", fields[1])
    return None if ok else "value"


def test_raw_rows(spark):
    rng = random.Random(4)
    base = ['1,@a,ACGT,!!!!', '1,>a,ACGT', '"1","@a","AC,GT","!!"', '1,@a,"AC\nGT","!""!!"', "1,>,A", "1,> >\t,A", "0123456789012345678,@a,A,!", "१,@a,A,!", "1,@a,A,!\r", "1,@a,A,!\r\r", "1,>a,AN\n", "", '"', '""', ",,,", '1,@a,A"C,!!!', '1,"@a"x,A,!', "1,@é,A,!", "1,@a,acgtn,!!!!!", '1,"@""a""",A,!']
    rows = [(k, t) for t in [*base, None] for k in ("fastq", "fasta", "other", None)]
    for _ in range(400):
        t = list(rng.choice(base))
        for _ in range(rng.randint(1, 3)):
            t.insert(rng.randint(0, len(t)), rng.choice('",\r\n@>A!x1 '))
        rows.append((rng.choice(["fastq", "fasta"]), "".join(t)))
    rows.append(("fastq", '1,@a,"' + "A" * 200_000 + '","' + '""' * 200_000 + '"'))
    table = [(i, k, t, "x", "y") for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame(table, "raw_id bigint, kind string, raw_text string, reason string, seq string")
    got = {r.raw_id: r.reason for r in raw_records.failed_rows(df).collect()}
    want = {i: reason(k, t) for i, k, t, _, _ in table if reason(k, t)}
    assert got == want
    for kind in ("fastq", "fasta"):
        ids = {r.raw_id for r in raw_records.strict_load(df, kind).collect()}
        assert ids == {i for i, k, t, _, _ in table if k == kind and i not in want}
    # Rows with one number each have their own fate.
    same = spark.createDataFrame([(1, "fasta", "1,>a,A", "x", "y"), (1, "fasta", "1,>a,X", "x", "y"), (1, "fasta", "1,>a,X", "x", "y"), (1, None, "1,>a,A", "x", "y")], df.schema)
    assert sorted(tuple(r) for r in raw_records.failed_rows(same).collect()) == [(1, "columns"), (1, "value"), (1, "value")]
    null_ids = df.withColumn("raw_id", df.raw_id * None)
    assert raw_records.failed_rows(null_ids).count() == len(want)
    assert raw_records.failed_rows(df.limit(0)).count() == 0


def test_newest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", None)], "ord bigint, v string, at int")
    assert sorted(r.v for r in sf.newest(df, "ord", "at").collect()) == ["b", "c"]
