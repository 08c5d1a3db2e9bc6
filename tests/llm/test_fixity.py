"""The fixity audit against a full join of two replicas."""

import pytest
from pyspark.sql import functions as F

from cellweave.llm import fixity

SCHEMA = "page_id long, url string, html string"
REPLICA = "file long, volume long, offset long, length long, digest string"


def brute(a, b):
    left, right = ({(r[0], r[1], r[2]): r[4] for r in x} for x in (a, b))
    return {(*k, left.get(k), right.get(k)) for k in left.keys() | right.keys() if left.get(k) != right.get(k)}


def audited(spark, a, b, **params):
    frames = (spark.createDataFrame(x, REPLICA) for x in (a, b))
    rows = fixity.audit(*frames, **params).collect()
    got = {(r.file, r.volume, r.offset, r.digest, r.other_digest) for r in rows}
    assert len(got) == len(rows)
    return got


def replica(files, volumes=1, records=3, of="d"):
    return [(f, v, k * 100, 100, f"{of}{f}.{v}.{k}") for f in files for v in range(volumes) for k in range(records)]


CASES = {
    "same": (replica([0, 1, 70]), replica([0, 1, 70])),
    "empty": ([], []),
    "one side is empty": (replica([5]), []),
    "files far apart": (replica([0]), replica([1000, 5000])),
    "a file more": (replica([-1, 0, 300]), replica([-1, 0, 300, 301])),
    "a volume more": (replica([0], 3), replica([0], 40)),
    "a record less": (replica([0, 9], 2, 5), [r for r in replica([0, 9], 2, 5) if r[:3] != (9, 1, 200)]),
    "one record": (replica(range(40)), [(*r[:4], "x" if r[:3] == (17, 0, 100) else r[4]) for r in replica(range(40))]),
    "all records": (replica([3, 4]), replica([3, 4], of="e")),
}


@pytest.mark.parametrize("name", CASES)
def test_against_a_full_join(spark, name):
    a, b = CASES[name]
    assert audited(spark, a, b, fanout=4, range_bytes=150) == brute(a, b)


def test_places_stay_where_records_change(spark):
    """Rows of one id, nulls, repeats and a long text: a changed character is one record, not those that follow."""
    rows = [(7, "u", f"<p>{k}") for k in range(6)] + [(None, None, None)] * 3 + [(None, "n", "<x>")] + [(8, "long", "<" + "word " * 200_000)] + [(7, "u", "<p>0")] * 2
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'o' offset", "1 file", "2 digest")
    changed = F.when(F.col("html") == "<p>3", "?p>3").otherwise(F.col("html"))
    written = fixity.warc_records(pages, changed, per_file=4).cache()
    assert written.count() == len(rows)
    by_volume = {}
    for r in written.collect():
        by_volume.setdefault((r.file, r.volume), []).append((r.offset, r.length))
    for own in by_volume.values():  # records of a volume follow each other without gaps
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
    assert max(map(len, by_volume.values())) < len(rows)
    found = fixity.audit(written, written.withColumn("digest", F.col("copy_digest"))).collect()
    assert len(found) == 1
    (own,) = written.where("digest <> copy_digest").collect()
    assert (found[0].file, found[0].volume, found[0].offset) == (own.file, own.volume, own.offset)
    assert fixity.warc_records(pages.limit(0)).count() == 0
