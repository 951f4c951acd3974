import collections
import hashlib

import corpus_pipeline
from weft.llm import quality_knn

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages(spark, tmp_path):
    """Each stage on all that its predecessor kept, against plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    space = quality_knn.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}
    good = [i for i, s in zip(rows, quality_knn.vote(space, [r.text for r in rows.values()])) if s >= 0.3]
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == first.columns
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        seen.append(docs.collect())
    assert sorted(r.doc_id for r in seen[0]) == sorted(good)
    sites = collections.defaultdict(set)
    first_at = {}
    for r in sorted(seen[0], key=lambda r: r.doc_id):
        for n, x in enumerate(r.text.split("\n")):
            if len(x.split()) >= 3:
                sites[x.strip()].add(r.source)
                first_at.setdefault(x.strip(), (r.doc_id, n))
    want = {r.doc_id: "\n".join(x for n, x in enumerate(r.text.split("\n")) if len(x.split()) < 3 or len(sites[x.strip()]) < 5 or first_at[x.strip()] == (r.doc_id, n)) for r in seen[0]}
    assert {r.doc_id: r.text for r in seen[1]} == want
    kept = {r.doc_id for r in seen[2]}
    shingles = {}
    for i, t in want.items():
        w = t.lower().split()
        shingles[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    ids = sorted(want)
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = shingles[a], shingles[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    assert kept == {find(i) for i in ids}
    times = collections.Counter(r.doc_id for r in seen[3])
    assert set(times) <= kept and max(times.values()) <= 2 and all(r.text == want[r.doc_id] for r in seen[3])
    words, mixed = sum(len(want[i].split()) for i in kept), sum(len(r.text.split()) for r in seen[3])
    assert abs(mixed - 1.5 * words) < 0.1 * words
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in seen[4]) == collections.Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in seen[3])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, seen[4]))
