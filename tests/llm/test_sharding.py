import hashlib
import random
from collections import defaultdict

from tidepool.llm import sharding


def brute(rows, limit):
    """The directory as it grows: a bucket over the limit splits on the next bit."""
    def h(i):
        return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    todo, out = [(0, 0, [(i, len((t or "").encode())) for i, t in rows])], []
    while todo:
        depth, prefix, docs = todo.pop()
        if sum(b for _, b in docs) <= limit or depth == 60:
            out += [(str(i), b, depth, prefix, sum(x for _, x in docs)) for i, b in docs]
            continue
        half = defaultdict(list)
        for d in docs:
            half[h(d[0]) >> (59 - depth) & 1].append(d)
        todo += [(depth + 1, 2 * prefix + bit, part) for bit, part in half.items()]
    return sorted(out)


def test_buckets_equal_those_of_a_growing_directory(spark):
    rnd = random.Random(5)
    rows = [(i, "x" * rnd.randint(0, 400)) for i in range(300)] + [(7, "copy" * 50)] * 40 + [(900, None), (901, ""), (None, "é")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, depth int")
    for limit in (500, 5_000, 10 ** 9):
        got = sharding.shards(docs, limit=limit).collect()
        assert sorted((str(r.id), r.bytes, r.depth, r.prefix, r.shard_bytes) for r in got) == brute(rows, limit)
        assert all(r.oversized == (r.shard_bytes > limit) for r in got)
    assert {r.id for r in sharding.shards(docs, limit=5_000).where("oversized").collect()} == {7}
    assert sharding.shards(docs.where("false"), limit=10).count() == 0
