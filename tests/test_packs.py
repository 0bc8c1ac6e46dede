"""The object store: packs cut, written, looked up block by block, and rewritten."""

import glob
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tracelume.sources import log, packs


def sha(b):
    return hashlib.sha256(b).hexdigest()


def bodies(n, seed=1):
    r = random.Random(seed)
    return [r.randbytes(r.choice((0, 1, 50, 400, 3000))) + str(k).encode() for k in range(n)]


def table(spark, some):
    return spark.createDataFrame([(sha(b), k, b) for k, b in enumerate(some)], "hash string, rank long, body binary").repartition(3)


def wanted(spark, hashes):
    return spark.createDataFrame([(h,) for h in hashes], "hash string")


LIMITS = {"block_bytes": 10_000, "most": 30, "pack_bytes": 60_000}


def test_blocks_and_packs_keep_their_limits(spark, tmp_path):
    some = bodies(400)
    index = packs.write(table(spark, some).union(table(spark, some[:5])), str(tmp_path), **LIMITS)
    rows = sorted((os.path.basename(r.pack), r.at, r.raw_at, r.raw_size, r.hash) for r in index.collect())
    assert [r[-1] for r in rows] == [sha(b) for b in some]  # once each, in order of rank
    block, pack = {}, {}
    for name, at, _, size, _ in rows:
        block.setdefault((name, at), []).append(size)
        pack[name] = pack.get(name, 0) + size
    assert len(block) > 20 and all(len(b) <= 30 and sum(b[:-1]) < 10_000 for b in block.values())
    assert len(pack) > 3 and all(n < 60_000 + 3100 for n in pack.values())
    assert {(r.hash, bytes(r.body)) for r in log.read_packs(spark, str(tmp_path)).collect()} == {(sha(b), b) for b in some}
    assert sorted(map(tuple, packs.scan_index(spark, str(tmp_path)).select("hash", "at", "size", "raw_at", "raw_size").collect())) == sorted(map(tuple, index.select("hash", "at", "size", "raw_at", "raw_size").collect()))
    packs.write(table(spark, [b"one more"]), str(tmp_path))
    assert packs.read_index(spark, str(tmp_path)).count() == 401


def test_a_lost_attempt_is_not_read(spark, tmp_path):
    packs.write(table(spark, bodies(20)), str(tmp_path))
    whole = b"DRP1\x01" + bytes(11) + log.block([(sha(b"left"), b"left")])
    (tmp_path / "pack-00000000-lost.pack").write_bytes(whole)
    os.makedirs(tmp_path / "_index/unfinished")
    assert packs.read_index(spark, str(tmp_path)).count() == 20
    assert packs.lookup(wanted(spark, [sha(b"left")]), packs.read_index(spark, str(tmp_path))).collect() == []
    assert packs.adopt(spark, str(tmp_path)).where(F.col("hash") == sha(b"left")).count() == 1


def test_refused_and_empty(spark, tmp_path):
    odd = table(spark, [b"a"]).union(spark.createDataFrame([("f" * 64, 9, b"b")], "hash string, rank long, body binary"))
    index = packs.write(odd, str(tmp_path))
    assert [r.hash for r in index.collect()] == [sha(b"a")]
    empty = packs.write(odd.limit(0), str(tmp_path / "none"))
    assert empty.count() == 0 and packs.lookup(wanted(spark, [sha(b"a"), None]), empty).count() == 0
    with pytest.raises(ValueError):
        log.block([])


@pytest.mark.parametrize("few", [packs.FEW, 2])
def test_lookup_reads_only_the_blocks_named(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(packs, "FEW", few)
    store, loose = tmp_path / "store", tmp_path / "loose"
    loose.mkdir()
    some = bodies(300)
    index = packs.write(table(spark, some), str(store), **LIMITS)
    where = {r.hash: r for r in index.collect()}
    hashes = [sha(b) for b in some]
    (loose / hashes[0]).write_bytes(log.put_frame(some[0]))
    (loose / hashes[1]).write_bytes(log.put_frame(b"other"))  # does not hash to its name: the pack has it
    (loose / sha(b"only loose")).write_bytes(log.put_frame(b"only loose"))
    (loose / sha(b"broken")).write_bytes(b"DRL1\x01broken")
    ask = [hashes[k] for k in (0, 1, 2, 2, 150, 299)] + [sha(b"only loose"), sha(b"broken"), "0" * 64, None]
    got = {r.hash: r for r in packs.lookup(wanted(spark, ask), index, str(loose)).collect()}
    want = {hashes[k]: some[k] for k in (0, 1, 2, 150, 299)} | {sha(b"only loose"): b"only loose"}
    assert {h: bytes(r.body) for h, r in got.items()} == want
    assert {h for h, r in got.items() if r.source == "loose"} == {hashes[0], sha(b"only loose")}
    named = {(where[hashes[k]].pack, where[hashes[k]].at, where[hashes[k]].size) for k in (1, 2, 150, 299)}
    assert sum(r.bytes_read for r in got.values() if r.source == "pack") == sum(n for _, _, n in named)
    assert sum(n for _, _, n in named) < sum(map(os.path.getsize, glob.glob(f"{store}/*.pack"))) / 5


def test_content_that_changed_is_refused(spark, tmp_path):
    index = packs.write(table(spark, [b"x" * 5000, b"y"]), str(tmp_path), block_bytes=10)
    (file,) = glob.glob(f"{tmp_path}/*.pack")
    data = bytearray(open(file, "rb").read())
    data[-1] ^= 255  # in the last block
    open(file, "wb").write(bytes(data))
    assert [r.hash for r in packs.lookup(wanted(spark, [sha(b"x" * 5000), sha(b"y")]), index).collect()] == [sha(b"x" * 5000)]
    open(file, "wb").write(bytes(data[:20]))
    assert packs.lookup(wanted(spark, [sha(b"x" * 5000)]), index).collect() == []


def test_repack_keeps_order_and_leaves_what_it_cannot_account_for(spark, tmp_path):
    some = bodies(200)
    index = packs.write(table(spark, some), str(tmp_path), **LIMITS)
    first = {r.pack for r in index.where(F.col("hash") == sha(some[0])).collect()}.pop()
    last = {r.pack for r in index.where(F.col("hash") == sha(some[-1])).collect()}.pop()
    assert first != last
    keep = [sha(b) for k, b in enumerate(some) if k % 3 == 0]
    os.truncate("/" + last.split(":/", 1)[1].lstrip("/"), 100)  # live objects of this pack are gone
    done = {r.pack: r for r in packs.repack(spark, str(tmp_path), wanted(spark, keep), **LIMITS).collect()}
    assert done[first].rewritten and not done[last].rewritten and done[first].live * 2 < done[first].entries
    after = packs.read_index(spark, str(tmp_path))
    assert {r.pack for r in after.select("pack").distinct().collect()} & set(done) == {last}
    fresh = after.where(F.col("pack") != last).collect()
    lost = {r.hash for r in index.where(F.col("pack") == last).collect()}
    assert [r.hash for r in sorted(fresh, key=lambda r: (r.pack, r.at, r.raw_at))] == [h for h in keep if h not in lost]
    got = {r.hash: bytes(r.body) for r in packs.lookup(wanted(spark, keep), after).collect()}
    assert got == {sha(b): b for b in some if sha(b) in set(keep) - lost}
    again = packs.repack(spark, str(tmp_path), wanted(spark, keep), **LIMITS)
    assert [r.pack for r in again.collect()] == [last]  # what was rewritten is dense now


def test_copy_on_write_survives_a_crash_between_its_commits(spark, tmp_path, monkeypatch):
    some = bodies(60)
    packs.write(table(spark, some), str(tmp_path))
    keep = [sha(b) for b in some[:10]]

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(packs, "retire", stop)
        with pytest.raises(RuntimeError):
            packs.repack(spark, str(tmp_path), wanted(spark, keep))
    index = packs.read_index(spark, str(tmp_path))
    assert index.count() == 70  # copies beside what they are copies of
    assert {r.hash: bytes(r.body) for r in packs.lookup(wanted(spark, keep), index).collect()} == {sha(b): b for b in some[:10]}


def test_a_sweep_is_carried_out(spark, tmp_path):
    loose, store = tmp_path / "loose", str(tmp_path / "store")
    loose.mkdir()
    some = bodies(12, seed=5)
    for k, b in enumerate(some):
        (loose / sha(b)).write_bytes(log.put_frame(b))
        age = 10 if k % 2 else 10_000  # seconds
        os.utime(loose / sha(b), (1_700_000_000 - age,) * 2)
    now = 1_700_000_000_000
    h = [sha(b) for b in some]
    nodes = spark.createDataFrame([(h[0], None, [f"s:{h[2]}", f"m:{h[3]}"]), (h[1], h[0], [f"m:{h[4]}"])], "hash string, parent string, entries array<string>")
    roots = wanted(spark, [h[1], h[6]])  # a tree, and a response
    ranks = spark.createDataFrame([(x, k) for k, x in enumerate(h)], "hash string, rank long")
    broken = nodes.where(F.col("hash") != h[0])
    assert packs.carry_out(spark, store, str(loose), roots, broken, ranks, now) == {"collected": 0, "packed": 3, "rewritten": 0}  # the root's parent is missing
    assert packs.carry_out(spark, store, str(loose), roots, nodes, ranks, now) == {"collected": 2, "packed": 1, "rewritten": 0}
    left = {f for f in os.listdir(loose) if not f.startswith(".")}
    assert left == {h[k] for k in (1, 3, 5, 7, 9, 11)}  # young ones, dead or alive
    index = packs.read_index(spark, store)
    assert {r.hash for r in index.collect()} == {h[k] for k in (0, 2, 4, 6)}
    found = packs.lookup(wanted(spark, [h[k] for k in (0, 1, 2, 3, 4, 6)]), index, str(loose))
    assert {r.hash: bytes(r.body) for r in found.collect()} == {h[k]: some[k] for k in (0, 1, 2, 3, 4, 6)}
    assert packs.carry_out(spark, store, str(loose), wanted(spark, [h[6]]), nodes, ranks, now)["rewritten"] >= 1
    assert {r.hash for r in packs.read_index(spark, store).collect()} == {h[6]}
