"""The Python data sources: many dialects in one job, pushed filters, stored pages as a table and as a stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quern.operators import chunk
from quern.sources import datasource


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


@pytest.fixture(scope="module")
def family(tmp_path_factory):
    """Ten thousand small files: four delimiters, byte order marks, names in several cases and orders, CRLF, quoted line feeds."""
    root = str(tmp_path_factory.mktemp("family"))
    for k in range(10_000):
        d, bom, end = ",;\t|"[k % 4], b"\xef\xbb\xbf" if k % 3 == 0 else b"", "\r\n" if k % 5 == 0 else "\n"
        names = [["Path", "Label", "text"], [" TEXT ", "path", "LABEL"]][k % 2]
        rows = [{"path": f"p{k}", "label": str(k % 7), "text": f'say "{k}"\nand more'}, {"path": f"q{k}", "label": "x" if k % 100 == 0 else "", "text": ""}]
        quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in '"\n,;\t|') else v
        lines = [d.join(names), *(d.join(quoted(r[n.strip().lower()]) for n in names) for r in rows)]
        write(f"{root}/d{k % 17}/part_{k:05d}.csv", bom + (end.join(lines) + end).encode())
    for name, data in {"empty.csv": b"", "header.csv": b"path,label,text\n", "notes.md": b"# no table", "_hidden.csv": b"path\nx\n", "blank.csv": b"path|label|text\n\n\nb|1|t\n\n", "short.csv": b"path;label;text\ns\ns2;5;t;more;more\n"}.items():
        write(f"{root}/odd/{name}", data)
    return root


SCHEMA = "path string, label int, text string, other string, source_file string"


def test_many_dialects_in_one_job(spark, family):
    df = datasource.read_files(spark, family, SCHEMA, "*.csv", partitionBytes="64000000")
    assert df.rdd.getNumPartitions() <= 40  # small files share partitions
    tracker, group = spark.sparkContext.statusTracker(), "one job"
    spark.sparkContext.setJobGroup(group, "read")
    rows = df.collect()
    spark.sparkContext.setJobGroup("after", "")
    assert len(tracker.getJobIdsForGroup(group)) == 1
    got = {(r["path"], r["source_file"]): r for r in rows}
    assert len(rows) == len(got) == 20_000 + 3
    for k in (0, 1, 2, 3, 4, 5, 4999, 9999):
        one, two = got[f"p{k}", f"part_{k:05d}.csv"], got[f"q{k}", f"part_{k:05d}.csv"]
        assert (one["label"], one["other"]) == (k % 7, None) and one["text"].replace("\r\n", "\n") == f'say "{k}"\nand more'
        assert two["label"] is None and two["text"] is None
    assert got["b", "blank.csv"]["label"] == 1 and got["s", "short.csv"]["text"] is None and got["s2", "short.csv"]["text"] == "t"


def test_pushed_filters(spark, family):
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    plain = datasource.read_files(spark, family, SCHEMA, "*.csv")
    where = [F.col("source_file") == "part_00042.csv", F.col("path").startswith("p999"), F.col("path").isin("p1", "q1", "zz"), F.col("text").isNull() & F.col("path").endswith("7"), (F.col("label") > 5) & F.col("text").contains('"77')]
    want = [sorted(map(tuple, plain.where(w).collect()), key=str) for w in where]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for w, rows in zip(where, want):
            df = datasource.read_files(spark, family, SCHEMA, "*.csv").where(w)
            assert sorted(map(tuple, df.collect()), key=str) == rows and rows
        one = datasource.read_files(spark, family, SCHEMA, "*.csv").where(where[0])
        assert one.rdd.getNumPartitions() == 1  # other files are not opened
        assert "ArrowEvalPython" not in one._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)


def test_errors_and_types(spark, family, tmp_path):
    with pytest.raises(Exception, match="missing columns"):
        datasource.read_files(spark, family, SCHEMA, "short.csv", ("path", "nothing")).collect()
    with pytest.raises(Exception, match="no nothing"):
        datasource.read_files(spark, family, SCHEMA, "nothing*").collect()
    with pytest.raises(Exception, match="cast them"):
        datasource.read_files(spark, family, "path date").collect()
    write(f"{tmp_path}/types.csv", b"i,l,d,b\n12,99999999999,1.5,TRUE\nx,1e3,nan?,maybe\n3000000000,-1,1e400,false\n")
    rows = datasource.read_files(spark, str(tmp_path), "b boolean, d double, l bigint, i int").collect()
    assert [tuple(r) for r in rows] == [(True, 1.5, 99999999999, 12), (None, None, None, None), (False, float("inf"), -1, None)]


def test_family_by_name(spark, tmp_path):
    write(f"{tmp_path}/a/cleaned_one.csv", b"text,Label\nt1,1\n")
    write(f"{tmp_path}/cleaned_two.csv", b"\xef\xbb\xbfSource;text\ns;t2\n")
    write(f"{tmp_path}/other.csv", b"no,thing\n1,2\n")
    df = datasource.read_family(spark, str(tmp_path))
    assert df.columns == ["label", "source", "text", "source_file"]
    assert sorted(map(tuple, df.collect()), key=str) == [("1", None, "t1", "cleaned_one.csv"), (None, "s", "t2", "cleaned_two.csv")]
    with pytest.raises(ValueError, match="more than 2"):
        datasource.read_family(spark, str(tmp_path), most=2)


FEED = "<feed xmlns='http://www.w3.org/2005/Atom'>{}</feed>"
ENTRY = "<entry><id>{0}</id><title> A\n {0} </title><summary>{1}</summary><published>{2}T00:00:00Z</published></entry>"


def test_pages_of_all_kinds(spark, tmp_path):
    entries = [ENTRY.format(k, "word " * (k % 4 * 10), "2013-01-01" if k % 2 else "2016-01-01") for k in range(20)]
    write(f"{tmp_path}/feed/page_2.xml", FEED.format("".join(entries[10:])).encode())
    write(f"{tmp_path}/feed/page_1.xml", FEED.format("".join(entries[:10])).encode())
    write(f"{tmp_path}/feed/page_10.xml", FEED.format("").encode())
    write(f"{tmp_path}/feed/page_11.xml", FEED.format("".join(entries)).encode())  # behind an empty page: never asked for
    got = datasource.read_pages(spark, f"{tmp_path}/feed", until="2014-12-31", least_words=10).orderBy("page", "place").collect()
    assert [r["id"] for r in got] == [str(k) for k in range(20) if k % 2 and k % 4 >= 1] and got[0]["title"] == "A 1"
    assert [r["id"] for r in datasource.read_pages(spark, f"{tmp_path}/feed", target=7, until="2014-12-31", least_words=10).orderBy("page", "place").collect()] == [r["id"] for r in got][:7]
    comments = [{"kind": "listing", "data": {"children": []}}, {"data": {"children": [{"kind": "t1", "data": {"id": str(k), "body": "w " * 300, "score": k}} for k in range(9)]}}]
    write(f"{tmp_path}/talk/1.json", json.dumps(comments).encode())
    write(f"{tmp_path}/talk/2.json", b"{broken")
    assert [r["id"] for r in datasource.read_pages(spark, f"{tmp_path}/talk", least_words=200, least_score=5).collect()] == ["6", "7", "8"]
    write(f"{tmp_path}/wiki/1.json", json.dumps({"query": {"pages": {"7": {"pageid": 7, "title": "T", "extract": "body text"}, "-1": {"missing": ""}}}}).encode())
    assert [tuple(r)[2:5] for r in datasource.read_pages(spark, f"{tmp_path}/wiki").collect()] == [("7", "T", "body text")]
    os.makedirs(f"{tmp_path}/none")
    assert datasource.read_pages(spark, f"{tmp_path}/none").count() == 0


def test_stream_stops_at_target_and_resumes(spark, tmp_path):
    page = lambda k: json.dumps({"items": [{"id": f"{k}-{j}", "text": "a b c"} for j in range(10)]}).encode()
    for k in range(2):
        write(f"{tmp_path}/in/page{k}.json", page(k))

    def run():
        df = datasource.stream_pages(spark, f"{tmp_path}/in", target=35)
        df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == sorted(f"{k}-{j}" for k in range(2) for j in range(10))
    assert len(run()) == 20  # nothing new
    for k in range(2, 9):
        write(f"{tmp_path}/in/page{k}.json", page(k))
    want = sorted([f"{k}-{j}" for k in range(3) for j in range(10)] + [f"3-{j}" for j in range(5)])
    assert run() == want == run()


def test_fill_topics(spark):
    rows = [("a", k) for k in range(12)] + [("b", k) for k in range(3)] + [(f"r{t}", k) for t in range(6) for k in range(4)] + [(None, 1)]
    df = spark.createDataFrame(rows, "topic string, place int").withColumns({"__n": F.lit(1), "__turn": F.lit(2)})
    take = lambda target, attempts: {(r["topic"], r["place"]) for r in chunk.fill_topics(df, "topic", "place", ["b", "missing", "a"], F.md5("topic"), target, 5, attempts).collect()}
    b, a = {("b", k) for k in range(3)}, {("a", k) for k in range(5)}
    import hashlib

    drawn = sorted((f"r{t}" for t in range(6)), key=lambda x: hashlib.md5(x.encode()).hexdigest())
    more = lambda n: {(t, k) for t in drawn[:n] for k in range(4)}
    assert take(3, 9) == b and take(4, 9) == b | a and take(8, 9) == b | a and take(9, 9) == b | a | more(1) and take(500, 2) == b | a | more(2)
    assert chunk.fill_topics(df, "topic", "place", ["a"], F.md5("topic"), 2, 5).columns == df.columns


def test_digests_of_files_of_any_size(spark, tmp_path):
    """A sparse file beyond what one row can hold, read in blocks by a task of constant memory."""
    import hashlib
    import resource

    size = 3 * 1024**3
    write(f"{tmp_path}/a/small.bin", b"abc")
    write(f"{tmp_path}/a/b/empty.bin", b"")
    write(f"{tmp_path}/a/_hidden.bin", b"no")
    with open(f"{tmp_path}/a/large.bin", "wb") as f:
        f.truncate(size)
    want, block = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size >> 24):
        want.update(block)
    got = {r["path"].rsplit("/", 1)[-1]: (r["bytes"], r["sha256"]) for r in datasource.file_hashes(spark, f"{tmp_path}/a").collect()}
    assert got == {"small.bin": (3, hashlib.sha256(b"abc").hexdigest()), "empty.bin": (0, hashlib.sha256(b"").hexdigest()), "large.bin": (size, want.hexdigest())}
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    reader = datasource.DigestReader({"path": f"{tmp_path}/a", "pattern": "large*"})
    assert len([x for p in reader.partitions() for x in reader.read(p)]) == 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # kilobytes
    assert datasource.file_hashes(spark, f"{tmp_path}/a", "none*").count() == 0
