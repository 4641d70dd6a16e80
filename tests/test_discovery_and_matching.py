"""A tree followed by scans, and matching by automata, against plain loops."""

import hashlib
import os
import random

import pytest

from triagelake.operators import multi_match, quality
from triagelake.sources.snapshots import Publish, SnapshotStore
from triagelake.streaming import discovery


def test_scans_tell_each_change_once(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"

    def write(name: str, text: str) -> None:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, ns=(10**18 + len(name) * 10**9, 10**18 + hash(text) % 10**6 * 10**9))

    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    discovery.create_tables(store, buckets=1)
    told = lambda n: {(r.source_path, r.change, r.old_path) for r in store.read("changes").filter(f"scan = {n}").collect()}
    files = lambda: {r.source_path: r.sha256 for r in store.read("files").collect()}
    for name, text in (("01_甲/a b.md", "one"), ("01_甲/b.md", "two"), ("02/c.md", "same"), ("02/d.md", "same"), ("02/e.txt", "no")):
        write(name, text)
    assert discovery.scan(store, str(root), 0) and told(0) == {(n, "added", None) for n in ("01_甲/a b.md", "01_甲/b.md", "02/c.md", "02/d.md")}
    assert not discovery.scan(store, str(root), 0)
    write("01_甲/b.md", "two, again")
    write("03/new.md", "three")
    (root / "02/c.md").rename(root / "02/moved.md")
    (root / "01_甲/a b.md").unlink()
    os.utime(root / "02/d.md")  # touched, not changed
    real = Publish.commit
    monkeypatch.setattr(Publish, "commit", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        discovery.scan(store, str(root), 1)
    monkeypatch.setattr(Publish, "commit", real)
    assert told(1) == set() and "01_甲/a b.md" in files()
    assert discovery.scan(store, str(root), 1)
    assert told(1) == {("01_甲/b.md", "changed", None), ("03/new.md", "added", None), ("02/moved.md", "renamed", "02/c.md"), ("01_甲/a b.md", "deleted", None)}
    assert files() == {n: hashlib.sha256(t.encode()).hexdigest() for n, t in (("01_甲/b.md", "two, again"), ("02/d.md", "same"), ("02/moved.md", "same"), ("03/new.md", "three"))}
    assert discovery.scan(store, str(root), 2) and told(2) == set()
    assert {r.category: r.n_files for r in discovery.folders(store.read("files")).collect()} == {"01_甲": 1, "02": 2, "03": 1}


def test_matching_equals_all_pairs(spark, monkeypatch):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("ab局市") for _ in range(rnd.randint(1, 6)))
    left = [(i, word()) for i in range(150)] + [(150, ""), (151, None), (152, "ab"), (153, "ab")]
    right = [(f"r{i}", word()) for i in range(120)] + [("x", None), ("y", ""), ("z", "ab"), ("a", "ab")]
    want = {}
    for i, a in left:
        found = [(b != a, -len(b), b, r) for r, b in right if a and b and (a in b or b in a)]
        if found:
            e, _, name, r = min(found)
            want[i] = (r, name, not e)
    ldf, rdf = spark.createDataFrame(left, "lid long, lname string"), spark.createDataFrame(right, "rid string, rname string")
    for part in (100_000, 25):
        monkeypatch.setattr(multi_match, "PART", part)
        got = {r.lid: (r.rid, r.rname, r.is_exact) for r in quality.containment_match(ldf, rdf).collect()}
        assert got == want
    assert quality.containment_match(ldf.limit(0), rdf).count() == 0 == quality.containment_match(ldf, rdf.limit(0)).count()


def test_equal_names_meet_once_in_few_blocks(spark, monkeypatch):
    """72 parts of patterns are not built once for each shuffle partition, and a name that many
    ids share is read once, whatever the number of ids."""
    assert multi_match.grid(200, 7_200_000, 200) == (72, 1) and multi_match.grid(7_200_000, 400_000, 200) == (4, 50) and multi_match.grid(0, 0, 200) == (1, 1)
    monkeypatch.setattr(multi_match, "LEAST_TEXTS", 1)
    seen = spark.sparkContext.accumulator(0)
    real = multi_match.automaton
    monkeypatch.setattr(multi_match, "automaton", lambda names, ids: (seen.add(len(names)), real(names, ids))[1])
    left = spark.createDataFrame([(i, f"name {i % 3} of all") for i in range(300)], "lid long, lname string")
    right = spark.createDataFrame([(f"r{i}", f"name {i % 3}") for i in range(60)], "rid string, rname string")
    got = {r.lid: r.rid for r in quality.containment_match(left, right).collect()}
    assert got == {i: min(f"r{j}" for j in range(60) if j % 3 == i % 3) for i in range(300)}
    assert 6 <= seen.value <= 3 * 2 * 4  # three names on either side, in no more than four buckets
